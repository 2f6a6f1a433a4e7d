"""Edit streams with one document's text as state."""
