"""The declarative schema, parameter resolution, experiments and the plan builder."""
