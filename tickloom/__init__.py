"""Price and metric time series on Spark: cleaning, features, scoring, monitoring."""
from tickloom.operators.blocks import Series, add_features

__all__ = ["Series", "add_features"]
