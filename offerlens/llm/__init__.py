"""Operators of a training-data pipeline. Nothing outside this subpackage depends on it."""
