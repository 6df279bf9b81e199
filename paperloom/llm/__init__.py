"""Operators that prepare large text corpora. Nothing outside this subpackage imports it."""
