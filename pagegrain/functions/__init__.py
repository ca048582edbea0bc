"""Column functions: text, geometry, scores, parsing, links and claims."""
