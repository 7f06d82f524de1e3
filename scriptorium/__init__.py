"""Corpus-scale operators on word-processing documents, as Spark DataFrames."""
