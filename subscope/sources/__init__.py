"""Declared schemas, the canonical table bundle and fixture views."""
