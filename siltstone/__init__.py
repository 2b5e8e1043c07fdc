"""A Spark-native analytics engine: relational operators, functions, full-text search, procedural UDFs and constraint-checked tables."""
