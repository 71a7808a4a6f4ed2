"""Compositions of operators: the query catalogue and the stages of the whole analysis."""
