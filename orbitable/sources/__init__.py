"""Readers and writers: text files, records, feature tables, grids."""
