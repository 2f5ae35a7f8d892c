"""Text-frequency analytics on Spark DataFrames: counts, sketches, PPMI and Zipf."""

__version__ = "0.1.0"
