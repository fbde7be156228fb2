"""Release-catalogue analytics as composable Spark DataFrame operators."""
