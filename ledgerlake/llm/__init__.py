"""Training-data operators: one module per operator, the queries over the shared tables in ``queries``."""
