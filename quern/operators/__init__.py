"""Set-based operators over pages, nodes, edges, vectors and hits."""
