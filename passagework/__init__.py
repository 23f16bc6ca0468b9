"""Document-retrieval analytics as Spark DataFrame operators."""
