"""From source text to rows of the code graph's tables."""
