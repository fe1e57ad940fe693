"""Operators for training data made from texts."""
