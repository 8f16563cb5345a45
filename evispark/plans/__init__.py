"""evispark plans."""
