"""Column-to-Column functions; everything here stays inside Catalyst expressions."""
