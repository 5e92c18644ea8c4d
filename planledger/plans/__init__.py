"""Execution plans: nodes, attempts, scores and index advice."""
