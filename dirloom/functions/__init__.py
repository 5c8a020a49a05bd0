"""functions of the people-directory engine."""
