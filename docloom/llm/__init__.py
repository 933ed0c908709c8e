"""Training-data operators: filtering, de-duplication, decontamination, tokens.

Every operator is a function from DataFrames to a DataFrame. Nothing outside
this subpackage imports it.
"""
