"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Every operator is a function from DataFrames to a
DataFrame; ``queries.py`` registers one query per operator and ``oracles.py`` holds the SQL twins.
"""
