"""Transcript and media-event analytics on Spark, keyed by video."""
