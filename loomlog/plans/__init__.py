"""Plans of loomlog."""
