"""Package of the functions of the engine."""
