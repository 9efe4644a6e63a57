"""Calibration: splits, linear and tree models, model choice, per-pixel configuration."""
