"""Training-data pipeline operators; each module documents its own method and edge cases."""
