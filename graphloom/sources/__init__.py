"""Schemas of node types, and loading of data sets."""
