"""Ardoise: loan-history features, scorecards and decisions on Spark."""

__version__ = "0.1.0"
