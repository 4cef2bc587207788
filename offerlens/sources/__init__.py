"""Tables that the queries start from."""
