"""Healing plans: what to do in which order, by rule or by a language model, and the engine that does it."""
