"""Operators on texts for training data. Nothing outside this subpackage imports it."""
