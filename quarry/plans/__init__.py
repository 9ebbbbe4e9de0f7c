"""Shared fixtures and distributed building blocks."""
