"""Structural variants from haplotype-tagged long reads, as Spark batch jobs over tables of aligned reads."""
