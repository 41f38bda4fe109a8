"""Requests and documents as they come."""
