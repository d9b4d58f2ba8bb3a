"""Land grading and field survey analytics on Spark."""
