"""Tidemark: frozen-period analytics over event tables, and corpus preparation, on PySpark."""
