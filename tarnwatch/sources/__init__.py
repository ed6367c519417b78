"""Readers, writers and the clean-up of what they read."""
