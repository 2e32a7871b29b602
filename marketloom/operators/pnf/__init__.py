"""Point-and-figure charts: many charts at once, one row a bar, column or cell, keyed by chart_id."""
