"""Query catalogue and multi-step dataflows."""
