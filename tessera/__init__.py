"""tessera: a PySpark-native engine for posting data and training-data preparation."""
