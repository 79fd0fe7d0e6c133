"""Checks on text as it arrives."""
