"""A relational engine on PySpark: a small SQL dialect, DataFrame operators and transactional tables."""

__version__ = "0.2"
