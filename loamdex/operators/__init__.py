"""loamdex operators."""
