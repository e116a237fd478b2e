"""Column expressions: text helpers, page text, tags and posting fields."""
