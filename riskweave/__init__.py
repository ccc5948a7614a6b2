"""riskweave: sensitive-data detection, risk scoring and label analytics as Spark DataFrame operations."""
