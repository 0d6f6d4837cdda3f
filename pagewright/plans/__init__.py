"""Plans: whole pipelines, and the tables that queries run on."""
