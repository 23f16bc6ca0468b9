"""Files, markup, evaluation sets and stored tables."""
