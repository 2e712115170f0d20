"""Configuration, templates and the forecasting pipeline."""
