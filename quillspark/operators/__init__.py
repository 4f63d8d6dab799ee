"""Package of the operators of the engine."""
