"""Operators that prepare text for training: one module for each of the ten operations."""
