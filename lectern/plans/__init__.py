"""The search language: text to syntax tree to one Catalyst predicate."""
