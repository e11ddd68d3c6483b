"""Incremental and streaming forms of the analyses."""
