"""Reports: compositions of the operators, one lazy plan each."""
