"""loamdex sources."""
