"""Readers and writers of documents, settings and questions."""
