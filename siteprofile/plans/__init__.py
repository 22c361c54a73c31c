"""Whole analyses and the registered queries."""
