"""Column functions: frames, projections, mesh codes and geometry."""
