"""The modules whose QUERIES and SQL make up the core's queries."""

from sitelode.plans import pages, probes, records, reports, serp, site, texts

MODULES = [records, serp, pages, texts, site, probes, reports]
