"""Column functions: CIGAR text, sequences, genotype likelihoods."""
