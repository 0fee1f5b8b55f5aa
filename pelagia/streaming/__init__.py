"""The incremental form of frame matching."""
