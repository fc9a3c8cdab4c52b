"""DataFrame operators: cohort building, exposure, description, survival, pooling."""
