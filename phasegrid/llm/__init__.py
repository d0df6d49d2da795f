"""Training-data operators for text corpora, each a Spark job over a documents table."""
