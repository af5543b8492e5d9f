"""Readers and writers of files of the domain."""
