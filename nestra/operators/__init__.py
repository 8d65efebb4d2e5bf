"""Operators on flat arrays, segments, descriptors and selectors."""
