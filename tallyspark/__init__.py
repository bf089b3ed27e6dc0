"""Customer and order-line analytics expressed as Spark DataFrame jobs."""
