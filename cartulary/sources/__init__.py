"""Files as rows and rows as files."""
