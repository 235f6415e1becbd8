"""Walks over streams of seeds."""
