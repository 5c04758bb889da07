"""Operators of a training-data pipeline, each usable alone on any DataFrame."""
