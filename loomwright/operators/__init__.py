"""Ways to load a target: overwrite, slices, merge, routines, scripts, grants."""
