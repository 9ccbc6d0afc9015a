"""logloom: conversation-log analytics and text-data operators on PySpark."""
