"""evispark: a Spark-first analytics engine for labelled media evidence."""

__version__ = "0.1.0"
