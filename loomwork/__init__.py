"""Analytics on Spark: a strict SQL dialect over mutable tables, and vector search."""
