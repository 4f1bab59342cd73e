"""strandweave: sequence analytics as Spark DataFrame operators."""
