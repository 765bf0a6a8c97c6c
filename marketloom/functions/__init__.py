"""Column -> Column expressions: cleaning, dates, business rules, report text."""
