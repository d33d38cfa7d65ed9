"""Operators for preparing large text corpora, each a function on DataFrames."""
