"""Operators put together: views over the sample tables, queries and the monthly pipeline."""
