"""Routing on dual-weighted street graphs, and the data preparation around it, on Spark."""

__version__ = "0.1.0"
