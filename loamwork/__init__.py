"""Evidence analytics on Spark: typed provenance graphs, text spans, agreement, evaluation and study statistics."""
