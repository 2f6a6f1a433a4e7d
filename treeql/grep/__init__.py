"""Code patterns: `find lang::pattern where { ... } replace { ... }`."""
