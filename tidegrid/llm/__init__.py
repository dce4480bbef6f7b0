"""Operators over training texts."""
