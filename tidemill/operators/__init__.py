"""Relational, windowed and operational operators on DataFrames."""
