"""Column functions: text identities, scalars, geometry."""
