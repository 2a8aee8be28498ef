"""Documents rendered from small results."""
