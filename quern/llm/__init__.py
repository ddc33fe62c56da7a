"""Operators for preparing large text corpora for model training.

Nothing else in :mod:`quern` imports this subpackage; it can be removed whole.
"""
