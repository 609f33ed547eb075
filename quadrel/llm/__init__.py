"""Operators for preparing training text. Nothing else in quadrel imports this subpackage."""
