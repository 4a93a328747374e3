"""framelake.sources."""
