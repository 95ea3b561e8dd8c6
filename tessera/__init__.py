"""Tessera: a PySpark-native engine for program facts held as DataFrames."""
