"""Readers that bind stored tables to the engine's logical tables."""
