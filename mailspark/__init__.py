"""Mail search, mailbox views, profiling and new-mail detection on Spark DataFrames."""
