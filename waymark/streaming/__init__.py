"""Request queue and status events as streams."""
