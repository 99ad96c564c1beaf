"""Scans, sinks and file catalogs."""
