"""All registered queries over the driver's tables, and their SQL."""

from herald.plans import extra, feeds, messages, more, notices, quality, search, searched

_MODULES = (messages, notices, search, searched, feeds, quality, more, extra)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
