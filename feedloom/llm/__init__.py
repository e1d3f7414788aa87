"""Operators for preparing training data: one module each, their queries in `queries`."""
