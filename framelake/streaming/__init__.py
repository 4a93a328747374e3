"""framelake.streaming."""
