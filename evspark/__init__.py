"""Evidence-container analytics on Spark."""
