"""DataFrame-to-DataFrame operators over data tables and catalogue tables."""
