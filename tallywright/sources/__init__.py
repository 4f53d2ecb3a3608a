"""Reading raw text and published tables, and writing reports."""
