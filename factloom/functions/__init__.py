"""Scalar functions: text predicates, canonical forms and hashes, JSON Schema."""
