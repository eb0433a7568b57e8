"""Operators for building text corpora: tokens, mixtures, languages, repairs, names, duplicates and vectors."""
