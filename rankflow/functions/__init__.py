"""Rankflow functions."""
