"""Part of fieldweave."""
