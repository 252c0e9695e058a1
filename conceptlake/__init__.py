"""conceptlake: a PySpark-native analytics engine for knowledge catalogs."""

__version__ = "0.1.0"
