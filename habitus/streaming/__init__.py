"""The access-log operators over unbounded input."""
