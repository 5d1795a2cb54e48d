"""The library's queries over the driver tables and their SQL, by name."""

from __future__ import annotations

from . import audio, catalogs, features, signals, speakers, speech, streams, texts, timelines

_MODULES = [timelines, speech, speakers, catalogs, texts, signals, audio, features, streams]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: x for m in _MODULES for k, x in m.SQL.items()}
