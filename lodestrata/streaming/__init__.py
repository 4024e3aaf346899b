"""Streams of telemetry and commit events."""
