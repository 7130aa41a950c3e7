"""Operators on signals in the long and the blocked layout."""
