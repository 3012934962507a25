"""Statements: parsing, and planning onto DataFrames."""
