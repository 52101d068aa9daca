"""DataFrame operators on node, edge and event tables."""
