"""Query text to syntax tree."""
