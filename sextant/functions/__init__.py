"""Column functions: text analysis, URLs, HTML, vectors, stemming."""
