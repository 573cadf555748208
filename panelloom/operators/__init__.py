"""Operators over panels: lag transforms, target transforms, models, intervals."""
