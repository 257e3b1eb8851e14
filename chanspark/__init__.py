"""A Spark-native engine for multichannel sensor time series and training-data preparation."""

__version__ = "0.1.0"
