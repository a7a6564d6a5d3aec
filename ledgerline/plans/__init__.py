"""Plans: table publishing (contract, staged overwrite), the two-step pipeline,
and the registry of named queries over the test tables."""
