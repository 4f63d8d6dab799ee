"""Package of the sources of the engine."""
