"""Readers and writers; formats whose libraries may be absent are plug-ins."""
