"""Column expressions: text, dates, labels, buckets, tails, hashes."""
