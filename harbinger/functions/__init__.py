"""Column expressions: text, calendar, scalar rules and signal lists."""
