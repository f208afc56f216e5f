"""Graph and text evidence analytics as PySpark DataFrame operators."""
