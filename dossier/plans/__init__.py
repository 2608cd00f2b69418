"""Compositions of operators and the domain views used by the registered queries."""
