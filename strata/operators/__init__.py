"""Operators over layered annotation data: selection, traversal, folds, recognition, profiles, edits, paths and actions."""
