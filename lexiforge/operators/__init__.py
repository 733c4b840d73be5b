"""Operators over corpus frames and record tables."""
