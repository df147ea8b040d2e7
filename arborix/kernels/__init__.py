"""NumPy kernels for one object (forest, graph, mesh, cloud) at a time; no Spark import."""
