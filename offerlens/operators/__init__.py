"""Table-level operators: ``(DataFrame, parameters) -> DataFrame``."""
