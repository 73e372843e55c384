"""Column functions: text and path rules, rounding, geometry, JSON rendering."""
