"""A document analytics engine on Spark."""
