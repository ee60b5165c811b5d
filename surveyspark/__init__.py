"""Weighted household-survey analytics on Spark DataFrames."""
