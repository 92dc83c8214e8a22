"""Readers: many-file series, loosely laid out sheets, JSON payloads."""
