"""Periodic reruns that read new files only."""
