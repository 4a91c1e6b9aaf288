"""cadenza: listening analytics on PySpark, declared as DataFrame plans."""

__version__ = "0.1.0"
