"""A PySpark-native engine for Vietnamese documents: routing, normalisation, structure, chunks."""
