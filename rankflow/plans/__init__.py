"""Rankflow plans."""
