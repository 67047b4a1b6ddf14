"""sievemill: Spark-first analytics over multi-run measurement data and text corpora."""

__version__ = "0.1.0"
