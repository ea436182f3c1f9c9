"""Readers, writers, run folders and the scratch area."""
