"""Row functions on file streams."""
