"""HTML as an interval-coded tree, and what is read from it."""
