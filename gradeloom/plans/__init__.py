"""Compositions of the operators: the public entry points, and the registered queries."""
