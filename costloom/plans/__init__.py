"""Jobs: operators wired between sources and sinks."""
