"""Column-level and metadata-level helpers shared by the operators."""
