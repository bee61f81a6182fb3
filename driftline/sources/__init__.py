"""Readers of snapshots, change logs and catalogs."""
