"""Composed plans: labeling steps, prompts, evaluation."""
