"""The queries of the engine, by group. Importing a module registers its queries."""
