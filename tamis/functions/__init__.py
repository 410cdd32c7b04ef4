"""Column functions: text keys, field scores, digests."""
