"""loamdex plans."""
