"""Multi-step batch plans and the catalogue of registered queries."""
