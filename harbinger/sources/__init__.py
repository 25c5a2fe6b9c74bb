"""Scans, the reference dimension, the asset manifest and sinks."""
