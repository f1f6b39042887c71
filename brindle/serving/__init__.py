"""Ways in besides Python: a command line, a length-prefixed text protocol and the PostgreSQL v3 protocol."""
