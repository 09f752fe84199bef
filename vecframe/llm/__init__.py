"""Operators for training data; nothing else in vecframe imports this subpackage."""
