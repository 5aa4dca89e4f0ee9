"""Statistics as DataFrame transforms."""
