"""Column functions and the skew-safe building blocks under the operators."""
