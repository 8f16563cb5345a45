"""evispark operators."""
