"""Rooftop-solar analytics as Spark plans: faces, obstacles, shade, packing, allocation and audit."""
