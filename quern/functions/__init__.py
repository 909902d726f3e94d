"""Column functions: text, numbers, urls, colours."""
