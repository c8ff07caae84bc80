"""Column -> Column functions, by theme."""
