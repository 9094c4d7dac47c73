"""vecspark: embedding compression, search and evaluation as Spark plans."""
