"""Lectio: a DataFrame-first engine that turns document collections into study material and measures it."""
