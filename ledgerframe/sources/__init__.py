"""Where rows come from and go to: the catalog, the change log, JSON."""
