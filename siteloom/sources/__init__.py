"""Readers and writers of variant files and their companions."""
