"""Parameters of the registered queries, chosen for the date range of the benchmark tables."""

START = "1996-01-01"
END = "2001-06-30"
MONTHS = ("1997-01", "2000-12")
FOCUS = "0007"
INDUSTRY = "Semiconductor"
EARLIEST = "1995-01-01"
TODAY = "2002-01-15"
