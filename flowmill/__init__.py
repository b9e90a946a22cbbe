"""Network-flow features, labels, models and metrics as Spark DataFrame jobs."""
