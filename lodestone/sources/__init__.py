"""Corpora: documents from tables or files, and filters over their paths."""
