"""Event detection and text-corpus analytics as PySpark DataFrame operators."""
