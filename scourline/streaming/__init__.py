"""Cleaning of streams."""
