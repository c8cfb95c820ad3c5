"""DataFrame-to-DataFrame operators: search, call graph, expansion, context, evaluation."""
