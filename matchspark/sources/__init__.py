"""Readers and writers for tracking feeds, labels and reports."""
