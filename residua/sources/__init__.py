"""Readers and views that give residues."""
