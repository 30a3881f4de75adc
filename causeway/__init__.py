"""A PySpark engine for append-only graphs of causally linked records."""
