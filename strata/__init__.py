"""Layered annotation data on Spark: tiers, relations, folds, recognition and profiles as DataFrame plans."""
