"""Whole queries: request parsing, service calls and the driver's query list."""
