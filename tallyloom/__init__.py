"""Spark jobs for business-intelligence loads, measures, visuals and app catalogues."""
