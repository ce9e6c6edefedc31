"""Policies, field names, masks and log-safe text: as Python on the driver and as Column expressions."""
