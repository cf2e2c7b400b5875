"""Streams of score records."""
