"""evispark sources."""
