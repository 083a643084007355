"""Operators for training data from texts. Nothing outside this folder imports it."""
