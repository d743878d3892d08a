"""Session analytics on Spark: events to sessions, funnels, start-of-session propensity models and their evaluation."""
