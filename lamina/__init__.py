"""lamina: two-stage text retrieval, its evaluation, and the care of its tables, on Spark."""
