"""Relational and graph operators over the trail network."""
