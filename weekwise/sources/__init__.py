"""Table schemas, loaders, sinks and the adapters that derive the six logical tables."""
