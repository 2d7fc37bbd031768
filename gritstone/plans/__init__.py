"""The registered queries of the engine."""
