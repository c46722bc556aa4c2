"""Genetic-interaction scoring of two-gene perturbation screens as Spark DataFrame plans."""
