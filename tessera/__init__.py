"""Document conformance checks and training-data operators as PySpark DataFrame functions."""
