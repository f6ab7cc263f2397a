"""loamdex functions."""
