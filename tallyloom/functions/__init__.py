"""Column builders: names, types, measures and script text."""
