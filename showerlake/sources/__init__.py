"""sources of the event engine."""
