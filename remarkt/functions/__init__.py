"""Column expressions: prices, titles, descriptions, features."""
