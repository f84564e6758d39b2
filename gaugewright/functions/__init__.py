"""Column functions: influence formulas, answer parsing, text rendering."""
