"""Column builders and small driver-side functions."""
