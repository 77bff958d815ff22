"""Corpus text analytics expressed as Spark DataFrame programs."""
