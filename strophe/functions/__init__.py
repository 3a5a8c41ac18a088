"""Column expressions: text, ids, similarity, scoring and lyric formatting."""
