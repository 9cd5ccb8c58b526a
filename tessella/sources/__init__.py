"""Readers and writers of the file formats the operators meet."""
