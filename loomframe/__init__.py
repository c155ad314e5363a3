"""Data preparation on Spark: rows with roles and positions, declared as DataFrame plans."""

__version__ = "0.1.0"
