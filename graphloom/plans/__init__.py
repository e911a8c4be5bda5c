"""Queries of several blocks, composed as DataFrames."""
