"""Plan building: techniques, strategies, query answering."""
