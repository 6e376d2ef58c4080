"""Reading, writing and laying out trip tables."""
