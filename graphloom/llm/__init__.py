"""Operators for preparing training corpora. Nothing else in graphloom imports this subpackage."""
