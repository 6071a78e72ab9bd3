"""Operators on payment tables: DataFrame to DataFrame."""
