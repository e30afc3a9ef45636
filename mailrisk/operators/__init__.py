"""DataFrame operators: rows in, rows out, nothing collected."""
