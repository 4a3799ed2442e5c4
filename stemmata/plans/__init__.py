"""Composed dataflows: the sweep, the tagger, the work packages, and the query registry."""
