"""Reading and writing tables of flights."""
