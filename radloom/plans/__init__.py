"""Whole flows, composed of operators; each is one lazy plan until written."""
