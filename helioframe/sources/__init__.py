"""Feeds, tables and models on storage."""
