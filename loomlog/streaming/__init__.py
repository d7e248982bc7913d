"""Streaming of loomlog."""
