"""Models: registry, isolation forest, attributions, prediction."""
