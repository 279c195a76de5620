"""Package of the core."""
