"""Feed scans and report sinks."""
