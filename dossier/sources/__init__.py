"""Readers, log tables and export writers."""
