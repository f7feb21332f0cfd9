"""Readers and writers for the file formats the operators work on."""
