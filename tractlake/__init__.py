"""Bronze, silver and gold table pipelines for civic and census data on Spark."""
