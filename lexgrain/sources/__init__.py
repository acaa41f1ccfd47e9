"""Readers and sinks with declared schemas."""
