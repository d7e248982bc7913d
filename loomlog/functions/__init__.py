"""Functions of loomlog."""
