"""Column expressions: time, pitch, text, money, settings."""
