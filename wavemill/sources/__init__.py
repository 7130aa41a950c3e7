"""Readers and writers of recordings, annotations and synthetic signals."""
