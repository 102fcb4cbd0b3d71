"""Reading table sets and writing synthetic ones."""
