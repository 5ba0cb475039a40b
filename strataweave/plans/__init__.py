"""Compositions of operators: reconcile, stitch, the star-schema adapter."""
