"""Queries by name. Importing this package registers all of them."""

from quire.plans import blocks, cart, cells, classify, documents, helpers, layout, mapping, office, packages, packs, relational, rendered, rules, scans, sinks, sources, text, timers  # noqa: F401
