"""Clinical document analytics on Spark."""
