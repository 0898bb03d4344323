"""Column-level helpers shared by the operators."""
