"""Evidence graph analytics on Spark: scans, graphs, retrieval, validation, evaluation."""
