"""Event-time forms of the rollups, for streams of events."""
