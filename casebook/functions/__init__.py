"""Column functions: text, dates, labels and vectors."""
