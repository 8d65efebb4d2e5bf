"""Ordered flat and nested arrays on Spark: element-wise, segmented and positional operators as DataFrame plans."""
