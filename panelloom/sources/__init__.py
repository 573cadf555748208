"""Panels from tables and by rule, and the store of fitted state."""
