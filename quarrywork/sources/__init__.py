"""Sources: files and texts in, typed chunks out."""
