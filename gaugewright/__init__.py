"""A Spark engine for controlled language-model evaluations and training-data pipelines."""

__version__ = "0.3.0"
