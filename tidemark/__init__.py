"""A PySpark engine for timeline and media analytics."""
