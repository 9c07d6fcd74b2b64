"""Analytics over property transactions, as Spark DataFrame jobs."""
