"""Daily marine feature tables as composable Spark DataFrame operators."""
