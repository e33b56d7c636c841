"""Column functions and numeric functions."""
