"""Reading and writing archive tables, triple files and recogniser answers."""
