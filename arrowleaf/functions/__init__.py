"""Programs as column expressions."""
