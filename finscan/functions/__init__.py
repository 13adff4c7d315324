"""Part of finscan."""
