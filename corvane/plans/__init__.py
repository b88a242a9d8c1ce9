"""Whole plans: answering questions, evaluation, and the registered queries."""
