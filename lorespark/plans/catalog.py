"""Every query of the library by name, with its SQL where there is one."""

from __future__ import annotations

from ..operators import code, convert, crawl, dependencies, diffs, discovery, fuzzy, graph, history, hosts, lightmarkup, markup, models, operations, repos, search, store, text, urls, vectors, web
from ..sources import codecs
from ..streaming import events

MODULES = (codecs, text, code, web, markup, lightmarkup, urls, hosts, convert, search, discovery, fuzzy, history, diffs, store, graph, dependencies, repos, crawl, models, vectors, operations, events)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.ORACLE.items()}
