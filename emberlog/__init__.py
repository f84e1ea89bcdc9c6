"""Telemetry events, issues and delivery batches as DataFrame operators."""
