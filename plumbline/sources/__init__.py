"""Where data comes from and where it goes: datasets, framework tables, CSV files."""
