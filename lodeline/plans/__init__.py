"""Query planning and the query catalogue."""
