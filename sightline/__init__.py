"""Site-evidence analytics on Spark."""
