"""functions of the event engine."""
