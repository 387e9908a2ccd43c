"""Guide-RNA design analytics on Spark."""
