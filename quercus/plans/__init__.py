"""Multi-step plans: training, scoring, privacy budgets, result analytics."""
