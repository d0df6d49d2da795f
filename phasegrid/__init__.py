"""Genotype-likelihood phasing and imputation as Spark jobs."""
