"""Operators for preparing language-model training data.

Self-contained: nothing else in :mod:`strophe` imports this subpackage.
"""
