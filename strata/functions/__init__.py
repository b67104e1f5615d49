"""Column functions: canonical lexical forms, names, pointers and escapes."""
