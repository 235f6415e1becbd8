"""Graph building, alias tables, random walks, neighbour sampling and their metrics."""
