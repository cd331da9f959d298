"""Saved-media catalogue analytics on Spark."""
