"""Scalar functions: identities, text, attribute bags, predicates, document extraction."""
