"""Reuse decisions over arriving timesteps."""
