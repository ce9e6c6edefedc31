"""Redaction and inspection of columns, formats, schemas and groups of rows."""
