"""Column functions: geometry, geodesy, text formats, probability."""
