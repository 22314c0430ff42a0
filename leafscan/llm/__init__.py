"""Training-data operators: one module for each operator, and ``queries`` for their registered queries."""
