"""Operators over evaluation records: pairing, metrics, effects, statistics, panels, generation, inference."""
