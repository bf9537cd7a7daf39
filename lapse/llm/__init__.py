"""Training-data operators: search, deduplication, filtering, mixing, encoding and sharding of text.

Every operator is a function from DataFrame(s) to DataFrame with column names
as parameters; ``queries.py`` registers one query per operator over the
driver's tables. Nothing else in the library imports this subpackage.
"""
