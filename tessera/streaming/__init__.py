"""Streaming counterparts of the profile / quality aggregates."""
