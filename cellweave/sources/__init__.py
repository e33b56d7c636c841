"""Readers and writers of interval and count formats."""
