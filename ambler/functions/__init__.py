"""Column functions: counter-based draws and edge biases."""
