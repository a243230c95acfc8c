"""Column functions: native ones on text, and Arrow-batched ones that read SQL."""
