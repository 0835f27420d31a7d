"""Report chains and the query catalog used by the driver and the bench."""
