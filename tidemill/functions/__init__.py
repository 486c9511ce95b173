"""Column functions: deterministic and additively homomorphic columns."""
