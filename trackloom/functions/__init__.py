"""Column functions: geometry, time and grading."""
