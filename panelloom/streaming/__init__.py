"""Panels that grow by micro-batches."""
