"""Scalar column expressions and fixed name lists."""
