"""Conformance and audit of generated artifacts, as Spark DataFrame operators."""
