"""tessera: a PySpark-native engine for curating, validating and measuring text datasets."""
