"""Where rows come from: star tables, uploaded files, the bound test tables."""
