"""rallygrid.streaming."""
