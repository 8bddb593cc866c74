"""Column functions: text, time validity, scores, names."""
