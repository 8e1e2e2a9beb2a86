"""Column-level building blocks and small distributed primitives."""
