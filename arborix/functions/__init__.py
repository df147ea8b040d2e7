"""Helpers that are not operators: session width."""
