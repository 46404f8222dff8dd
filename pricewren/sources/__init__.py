"""Readers of supplier files, masters and paginated feeds."""
