"""marlstone: a PySpark-native engine for curating and analysing large catalogues."""

__version__ = "0.1.0"
