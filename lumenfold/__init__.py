"""lumenfold: document analytics over journals, features and vectors, expressed as Spark plans."""

__version__ = "0.1.0"
