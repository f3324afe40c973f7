"""Sinks: where deliveries of a micro-batch go."""
