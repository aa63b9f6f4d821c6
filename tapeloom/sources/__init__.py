"""Readers and writers, and the adapter that turns generic tables into a tape."""
