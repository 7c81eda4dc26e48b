"""Queries and SQL of this subpackage, for the entry module."""

from __future__ import annotations

from irloom.llm import ann, chat_format, decontamination, language_id, mixing, quality, sharding, simhash, toxicity, url_filters

_MODULES = [chat_format, ann, sharding, language_id, url_filters, simhash, toxicity, decontamination, mixing, quality]


def queries():
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: q for m in _MODULES for k, q in m.ORACLE.items()}
