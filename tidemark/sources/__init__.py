"""Readers and writers of the formats that runs, conversations and data sets come in."""
