"""tessera: a PySpark-native analytics engine (operators, sources, functions, plans, streaming)."""
