"""Whole plans: building, publishing and reading generations."""
