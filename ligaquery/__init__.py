"""Spark-first analytics for RNA-RNA interaction sequencing data and for preparing training data."""

__version__ = "0.1.0"
