"""Sources, scans and sinks."""
