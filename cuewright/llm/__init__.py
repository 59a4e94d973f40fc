"""Training-data operators: one module per operator, ``catalog`` for the registered queries."""
