"""Where rows come from: the corpus tables, JSON feeds, and a source with pushed filters."""
