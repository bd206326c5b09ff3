"""Operators for preparing training corpora; self-contained, nothing else in the library imports it."""
