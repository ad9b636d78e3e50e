"""Budgeted corpus selection and curation on Spark DataFrames."""
