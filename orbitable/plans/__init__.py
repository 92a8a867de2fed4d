"""End-to-end plans: feature extraction, model search, reports."""
