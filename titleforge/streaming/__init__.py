"""Progress events as streams."""
