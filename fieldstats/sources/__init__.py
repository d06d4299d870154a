"""Reading surveys, writing results, small lookup tables."""
