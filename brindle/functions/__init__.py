"""Functions that the dialect has beyond Spark's own."""
