"""Meridia: similarity retrieval, evaluation statistics and corpus audits as Spark plans."""
