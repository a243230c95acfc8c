"""DataFrame operators on statements, clusters, catalogs and plans."""
