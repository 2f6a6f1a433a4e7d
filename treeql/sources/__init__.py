"""Reading sources and telling their languages."""
