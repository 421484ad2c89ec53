"""Column functions: names, paths, versions, identities."""
