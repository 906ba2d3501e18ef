"""Relational operators over meshes, grids, voxels and statistics tables."""
