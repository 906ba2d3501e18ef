"""Configurations and whole queries."""
