"""Operators for building text training data; nothing outside this subpackage imports it."""
