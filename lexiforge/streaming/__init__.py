"""Continuous maintenance of an index."""
