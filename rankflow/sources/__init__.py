"""Rankflow sources."""
