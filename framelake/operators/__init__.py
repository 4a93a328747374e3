"""framelake.operators."""
