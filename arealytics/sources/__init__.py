"""Readers, per-source cleaning rules and sinks."""
