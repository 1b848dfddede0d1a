"""Operators a training-data pipeline needs, each a module of its own; ``queries`` registers them."""
