"""Document and table analytics written as Spark DataFrame operators."""
