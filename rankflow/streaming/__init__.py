"""Rankflow streaming."""
