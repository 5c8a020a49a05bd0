"""operators of the people-directory engine."""
