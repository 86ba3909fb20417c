"""Part of lexshift."""
