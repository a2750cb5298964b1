"""Column functions: text, identity hashes, URLs, dates, JSON, vectors."""
