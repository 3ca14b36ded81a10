"""Operators of a training-data pipeline, apart from the session library."""
