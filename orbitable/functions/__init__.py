"""Column-level functions: geometry, text labels, energies, distribution tails."""
