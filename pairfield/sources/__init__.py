"""Readers of annotation layouts and writers of results."""
