"""The query language: text to a tree, tree to a plan."""
