"""Analytics over council corpora, written as Spark DataFrame operators."""
