"""Readers of landed payloads, logs and configuration, and exports."""
