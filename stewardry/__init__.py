"""Part of stewardry."""
