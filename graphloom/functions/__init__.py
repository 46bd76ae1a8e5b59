"""Column functions: names, paths, predicates and scores."""
