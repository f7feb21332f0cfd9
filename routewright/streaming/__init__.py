"""Incremental versions of the running counters."""
