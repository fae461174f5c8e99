"""Operators on telemetry events, as DataFrame transformations."""
