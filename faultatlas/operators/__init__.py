"""DataFrame operators, one module per area of the model."""
