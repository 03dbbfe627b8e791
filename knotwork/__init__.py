"""Knotwork: typed, bitemporal knowledge-graph analytics as DataFrame programs."""
