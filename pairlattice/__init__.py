"""Contact-matrix analytics on Spark: pairs, cells, norms, expected values, QC."""
