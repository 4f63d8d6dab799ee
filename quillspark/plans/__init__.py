"""Package of the plans of the engine."""
