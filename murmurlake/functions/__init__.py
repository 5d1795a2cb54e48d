"""Column functions and building blocks."""
