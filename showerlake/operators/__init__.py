"""operators of the event engine."""
