"""Places where units come from."""
