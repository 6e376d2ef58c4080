"""The six end-to-end jobs."""
