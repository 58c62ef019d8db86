"""Kernels of the engine."""
