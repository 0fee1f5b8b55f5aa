"""Operators from DataFrame to DataFrame, keyed by deployment, image set or video."""
