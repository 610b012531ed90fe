"""quire: durable document pipelines and their analytics as plain PySpark transformations."""
