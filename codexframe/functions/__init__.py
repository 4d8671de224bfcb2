"""Column functions: text, chunk windows, vectors, validation of model output."""
