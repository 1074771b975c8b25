"""Relational and analytical operators for Spark DataFrames."""
