"""DataFrame operators over call sites, statements, predicates, metadata, paths and parameters."""
