"""framelake.functions."""
