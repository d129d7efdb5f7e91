"""Evaluation of report pairs, and cleaning of the data behind it, on Spark DataFrames."""
