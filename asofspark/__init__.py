"""Point-in-time market research on Spark: DataFrame to DataFrame operators."""
