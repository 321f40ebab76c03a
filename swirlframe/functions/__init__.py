"""Column functions: fixed point, triangle tests, bounds, transforms."""
