"""Operator families: cleaning (C), search (P), features (F), scenarios (J),
profile (A, T), kpi (K, M3-M7) and model (M1, M2, S2, T1, T2)."""
from . import cleaning, features, kpi, model, profile, scenarios, search

__all__ = ["cleaning", "features", "kpi", "model", "profile", "scenarios", "search"]
