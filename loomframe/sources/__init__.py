"""Readers for many formats, chosen by content."""
