"""Operators: ``DataFrame`` in, ``DataFrame`` (or a small plan) out."""
