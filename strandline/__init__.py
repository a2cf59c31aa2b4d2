"""A PySpark engine for short-read sequencing data and relational queries."""
