"""Product analytics and score-table analysis as Spark DataFrame operators."""

__version__ = "0.1.0"
