"""Whole runs: read, compute, write. Each returns the paths it wrote."""
