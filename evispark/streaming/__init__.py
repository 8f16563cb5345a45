"""evispark streaming."""
