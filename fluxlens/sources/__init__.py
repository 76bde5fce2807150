"""Readers and writers: binary flow logs, export packets, text, CSV and SQL images."""
