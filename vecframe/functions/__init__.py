"""Column builders: text analysis and ranking, vector distances, geography, and the expression language."""
