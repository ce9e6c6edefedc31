"""Redaction, sensitivity inspection and masking for PySpark DataFrames."""
