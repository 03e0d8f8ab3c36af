"""Column builders. Every function takes and returns Spark Columns only."""
