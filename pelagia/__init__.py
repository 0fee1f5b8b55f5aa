"""Telemetry and frame-metadata operators for Spark."""
