"""Column expressions. Nothing in here starts a job."""
