"""Solvers for what is sequential or combinatorial within one episode: grouped maps, one bounded episode a group."""
