"""Column functions: numbers, labels, arrays and digests."""
