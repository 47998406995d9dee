"""Spatial and semantic analytics on PySpark."""
