"""inkweave: note-graph and change-stream analytics as Spark DataFrame functions."""
