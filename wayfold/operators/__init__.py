"""DataFrame operators: networks, candidate search, routing, hidden-Markov matching, alignment and evaluation."""
