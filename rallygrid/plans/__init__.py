"""rallygrid.plans."""
