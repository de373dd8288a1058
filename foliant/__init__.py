"""Document retrieval and hygiene analytics, expressed as Spark DataFrame plans."""
