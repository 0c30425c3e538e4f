"""Jobs that run from the command line; each puts its work in a function that takes a session."""
