"""Operators that prepare text corpora for training. Nothing outside of this subpackage imports it."""
