"""loomlog: DataFrame operators for append-only conversation and event logs."""

__version__ = "0.1.0"
