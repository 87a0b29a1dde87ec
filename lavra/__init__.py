"""Document analytics on PySpark: extraction, search, networks, review and integrity as DataFrame plans."""

__version__ = "0.1.0"
