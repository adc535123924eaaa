"""Column functions: numbers, texts, URLs, validation and display."""
