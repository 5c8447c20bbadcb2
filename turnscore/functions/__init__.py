"""Column expressions: prompt rendering, reply parsing, text helpers, stable ids, statistics."""
