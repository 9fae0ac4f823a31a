"""Readers and writers of the file formats around the score tables."""
