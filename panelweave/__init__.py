"""Panel analytics as Spark jobs: shaping, features, analogs, ranking, books and their evaluation."""

__version__ = "0.1.0"
