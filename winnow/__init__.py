"""winnow: content de-duplication and corpus preparation as Spark DataFrame operators."""
