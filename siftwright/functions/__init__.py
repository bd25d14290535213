"""Column functions; each maps Columns to Columns and stays inside Catalyst."""
