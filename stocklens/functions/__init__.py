"""Column helpers, skew-safe primitives and grouped metrics."""
