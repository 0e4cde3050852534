"""Column-level helpers (pure expressions, no actions, no UDFs)."""
