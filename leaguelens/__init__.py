"""Season-competition analytics as composable Spark DataFrame operators."""
