"""Choosing the next batch: greedy novelty, determinantal point processes, Pareto fronts, surrogate acquisition."""
