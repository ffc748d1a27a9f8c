"""Training-data operators: one module for each, plus their registered queries."""
