"""Training-data operators: one module per operator, helpers beside them; nothing outside imports this package."""
