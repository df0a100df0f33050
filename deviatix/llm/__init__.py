"""Operators for large training-data pipelines: one module per operator, the registered queries in ``queries``."""
