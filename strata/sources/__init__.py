"""Reading and writing documents, edit programs and renderings."""
