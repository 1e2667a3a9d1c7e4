"""Column functions: text, HTML, URLs, queries, vectors, and their word lists."""
