"""Column builders: road tags, text, arithmetic and arrays."""
