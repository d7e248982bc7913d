"""Sinks of loomlog."""
