"""Composed jobs, SQL over the saved tables, test views and the query registry."""
