"""Operators for preparing training text on Spark. Nothing else in the library imports this package."""
