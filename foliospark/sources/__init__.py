"""Readers and writers of the file shapes that extraction runs leave behind."""
