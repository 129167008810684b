"""Operators for preparing training data: one module per operator, `catalog` registers their queries."""
