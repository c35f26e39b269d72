"""How work is laid out on a cluster: materialised steps, graph closure, top-N."""
