"""Sources and sinks: artifact files with quarantine, and the versioned store."""
