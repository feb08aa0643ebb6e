"""Rankflow operators."""
