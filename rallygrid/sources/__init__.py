"""rallygrid.sources."""
