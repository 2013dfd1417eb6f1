"""Readers and writers of delimited files, text-line corpora and reports."""
