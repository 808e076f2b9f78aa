"""End-to-end drivers and the registered queries."""
