"""framelake.plans."""
