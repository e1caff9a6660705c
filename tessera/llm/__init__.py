"""Operators for training data at corpus scale; nothing outside this package imports it."""
