"""Operators composed into jobs, and the registered queries."""
