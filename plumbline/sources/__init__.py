"""Sources and sinks that need no network."""
