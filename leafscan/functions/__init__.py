"""Column functions: tokens, similarities, colours, hashes."""
