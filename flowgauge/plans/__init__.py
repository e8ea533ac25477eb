"""End-to-end reports composed from sources, operators and sinks."""
