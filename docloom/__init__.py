"""docloom: document analytics on Spark."""
