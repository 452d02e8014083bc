"""Dataset specs, scans and sinks."""
