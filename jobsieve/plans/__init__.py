"""Operators composed into the three jobs a user runs."""
