"""Column functions: cleaning, times, text, URLs and HTML."""
