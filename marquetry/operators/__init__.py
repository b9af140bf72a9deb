"""DataFrame operators: ``(df, ..., params) -> df``."""
