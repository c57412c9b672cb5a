"""wardenflow: security analytics as composable Spark DataFrame transformations."""
