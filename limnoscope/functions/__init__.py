"""Column expressions: masks, spectral indices, geometry, text, time and numbers."""
