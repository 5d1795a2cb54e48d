"""Reading and writing, and views over tables."""
