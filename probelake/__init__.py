"""probelake: a PySpark-native engine for probing, calibrated evaluation and large-scale data preparation."""

__version__ = "0.1.0"
