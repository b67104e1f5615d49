"""Bindings of tables to tiers and relations, and the registered queries."""
