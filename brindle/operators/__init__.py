"""What statements do: definitions, changes, and reports on tables."""
