"""Operators for training data; nothing else in quern imports this subpackage."""
