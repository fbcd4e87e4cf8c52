"""How plans are run: sessions, lineage, registries and the command line."""
