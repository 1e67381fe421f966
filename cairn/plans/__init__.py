"""Query plans: the statement API and the catalogue of registered queries."""
