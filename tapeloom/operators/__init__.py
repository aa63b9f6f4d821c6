"""Table-to-table jobs over event, bar and decision tables."""
