"""Column functions: grams, regular expressions over bytes, match positions."""
