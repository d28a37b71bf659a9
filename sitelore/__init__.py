"""Site-knowledge engine: many crawled sites as tables, every step for all sites at once."""
