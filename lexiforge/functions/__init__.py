"""Column expressions and vectorised digests."""
