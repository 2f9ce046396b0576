"""Operators for preparing training data. Nothing else in meterloom imports this subpackage."""
