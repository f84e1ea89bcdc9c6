"""Sources of events, reports and queues."""
