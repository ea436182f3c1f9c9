"""Structured Streaming jobs: resumable annotation and live consensus counts."""
