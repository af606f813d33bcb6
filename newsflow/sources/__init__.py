"""Readers for landed payloads, CSV history and stored tables."""
