"""Whole evaluations: configuration, tables and sinks."""
