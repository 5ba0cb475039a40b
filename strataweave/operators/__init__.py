"""Relational and graph operators over node, edge and call-graph tables."""
