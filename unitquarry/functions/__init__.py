"""Column-level building blocks: text and vector expressions."""
