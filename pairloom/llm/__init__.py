"""Operators for training data; nothing else in pairloom imports this subpackage."""
