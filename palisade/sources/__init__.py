"""Readers of bodies and event streams."""
