"""rallygrid.operators."""
