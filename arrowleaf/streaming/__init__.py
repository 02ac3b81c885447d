"""Programs over streams."""
