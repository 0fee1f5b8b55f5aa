"""Readers and writers of logs, images, documents and reports."""
