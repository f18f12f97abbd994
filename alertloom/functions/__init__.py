"""Column builders: every function takes columns and gives a column, evaluated inside Spark."""
