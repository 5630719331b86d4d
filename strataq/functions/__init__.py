"""Column functions: no Spark action, no Python on the executors."""
