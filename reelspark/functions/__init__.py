"""Column functions: text, time, addresses, integers, checksums."""
