"""Readers and writers of the interchange tables."""
