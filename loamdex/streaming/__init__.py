"""loamdex streaming."""
