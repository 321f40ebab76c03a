"""Readers and writers: raw arrays, Amira lattices, text and CSV reports, records."""
