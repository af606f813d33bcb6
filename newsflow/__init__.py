"""News and sentiment pipeline expressed as Spark DataFrame operators."""
