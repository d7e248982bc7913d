"""Operators of loomlog."""
