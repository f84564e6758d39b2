"""Sources and sinks: JSON lines, result trees, registries, adapters over the test tables."""
