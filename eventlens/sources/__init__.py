"""Readers, writers and table scans."""
