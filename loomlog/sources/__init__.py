"""Sources of loomlog."""
