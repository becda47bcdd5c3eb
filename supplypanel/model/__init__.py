"""Risk model: preparation, fitting, ranking metrics and explanations."""
