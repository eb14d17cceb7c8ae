"""Column expressions that every operator shares."""
