"""Readers of database exports, and writers."""
