"""Mutation burden of genomic annotations by permutation, as Spark DataFrames."""
