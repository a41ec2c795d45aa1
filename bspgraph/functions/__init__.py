"""Global aggregators and scalar helpers."""
