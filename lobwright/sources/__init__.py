"""Reading and writing snapshot tables."""
