"""Readers and writers of media containers."""
