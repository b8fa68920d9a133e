"""Column factories: losses, gains, encodings, normalisers."""
