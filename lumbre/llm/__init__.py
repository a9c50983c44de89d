"""Operators for preparing training text: filters, duplicates, models, packing and formatting.

Every operator takes DataFrames and column names and returns DataFrames; their named queries are in
``lumbre.llm.queries``.  Nothing else in the library imports this package.
"""
