"""Column-level helpers shared by all operators."""
