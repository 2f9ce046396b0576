"""Part of meterloom; see the README."""
