"""Reading exports, inventories, page caches, sitemaps and manifests; writing results."""
