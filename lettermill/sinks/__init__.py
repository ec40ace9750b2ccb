"""Stored tables and writers."""
