"""Analytics on star schemas, expressed as Spark DataFrame plans."""
