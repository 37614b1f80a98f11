"""Multi-step fits built from the operators."""
