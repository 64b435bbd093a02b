"""Part of scholarforge."""
