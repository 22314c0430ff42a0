"""Search and annotation of recognised documents, and training-data operators, as Spark DataFrame plans."""

__version__ = "0.1.0"
