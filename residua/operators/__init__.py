"""Relational operators on residues, contacts and scores."""
