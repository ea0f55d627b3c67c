"""Column expressions: text parsing, patterns, format validators and key hashes."""
