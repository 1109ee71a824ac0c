"""Corpus operators; nothing outside this folder imports it."""
