"""Registered queries: each module has ``QUERIES`` and ``SQL``."""

from tessera.plans import catalogue, graphs, retrieval, services

ALL = (retrieval, graphs, services, catalogue)
