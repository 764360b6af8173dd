"""reviewlake: DataFrame/SQL operators for code-change review data on Spark."""

__version__ = "0.1.0"
