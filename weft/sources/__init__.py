"""Readers and writers: source files, manifests, event logs, run logs."""
