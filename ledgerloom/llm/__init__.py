"""Operators that prepare large text collections; nothing outside this subpackage imports it."""
