"""Models and the cross-validation runner."""
