def ids(frame):
    return [row["id"] for row in frame.collect()]
