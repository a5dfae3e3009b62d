"""Price-move analytics as Spark DataFrame transformations."""
