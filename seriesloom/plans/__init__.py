"""Compositions of operators into whole jobs, and the catalog of registered queries."""
