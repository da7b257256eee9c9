"""Compositions of operators: the end-to-end jobs and the registered queries."""
