"""Readers and writers for snapshots, results, logs, pins and configuration."""
