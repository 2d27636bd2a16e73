"""Corpus-scale checking and search of reports, written on Spark DataFrames."""
