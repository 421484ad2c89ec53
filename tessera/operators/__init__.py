"""Operators over fact tables and findings."""
