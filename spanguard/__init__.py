"""spanguard: find, mask, score and track sensitive data with Spark."""
