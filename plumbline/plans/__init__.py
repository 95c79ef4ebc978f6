"""Whole jobs composed from operators: running rules, previewing, applying suggestions."""
