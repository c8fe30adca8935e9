"""Analytics over columns of floating-point numbers, as DataFrame expressions."""
