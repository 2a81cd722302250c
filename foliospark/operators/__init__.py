"""DataFrame operators: layout, blocks, tables, runs, paired comparison, gates, runner."""
