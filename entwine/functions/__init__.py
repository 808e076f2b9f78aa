"""Column functions and shared session helpers."""
