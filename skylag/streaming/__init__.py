"""The batch operators on file streams."""
