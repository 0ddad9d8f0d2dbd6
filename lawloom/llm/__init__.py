"""Operators of a training-data pipeline, each a module; ``queries`` registers them."""
