"""Training-data operators: scoring, dedup, search, mixing and packing of text corpora on Spark."""
