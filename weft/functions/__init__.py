"""Column functions: identities, paths, text helpers."""
