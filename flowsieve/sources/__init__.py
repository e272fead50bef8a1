"""Readers and writers of flow tables, metrics and manifests."""
