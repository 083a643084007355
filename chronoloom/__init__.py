"""chronoloom: time-series features, point-in-time joins and data preparation on Spark."""
