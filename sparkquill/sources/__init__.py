"""Readers, writers and saved indexes."""
