"""rallygrid.functions."""
