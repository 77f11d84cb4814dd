"""Corpus analytics on Spark: DataFrame operators for text corpora, recognition scores and page layout."""
