"""Recipes, model specs, validation plans, and the registered queries."""
