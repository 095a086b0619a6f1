"""Column expressions: no actions, no joins, no Python on the executors."""
