"""Plan-level helpers: shared scratch tables, connected components, ordered numbering."""
