"""surcos: DataFrame operators for customer and daily-series analytics on Spark."""
