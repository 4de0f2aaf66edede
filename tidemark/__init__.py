"""Event-study and text-processing engine expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
