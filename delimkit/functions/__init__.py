"""Part of delimkit."""
