"""Operators that prepare language-model training data, and the queries that apply them to the test tables."""
