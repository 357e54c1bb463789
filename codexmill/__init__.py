"""codexmill: a Spark-native search and text-processing engine over libraries of books."""

__version__ = "0.1.0"
