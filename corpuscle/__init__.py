"""Corpus analytics on Spark: parameterised DataFrame functions over text corpora."""
