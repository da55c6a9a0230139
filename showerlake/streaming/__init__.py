"""streaming of the event engine."""
