"""Retrieval operators: frames in, frames out."""
