"""Where rows come from and go to: source trees, index snapshots, reports."""
