"""Column-level building blocks: text, lexicons, stylometry, sampling keys."""
