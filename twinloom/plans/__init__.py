"""Whole workflows: discover, allocate, synthesize, evaluate, sweep."""
