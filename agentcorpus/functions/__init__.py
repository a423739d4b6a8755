"""Column expressions used inside the table jobs; no row-at-a-time Python."""
