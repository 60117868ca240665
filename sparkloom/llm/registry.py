"""All queries and SQL of the subpackage, gathered from its modules."""

from __future__ import annotations

from sparkloom.llm import chat, decontaminate, fim, mainhtml, minhash, packing, pivots, resample, sampling, suffixes, tokencount, toxicity, urls

MODULES = [pivots, urls, decontaminate, toxicity, mainhtml, chat, suffixes, sampling, tokencount, minhash, resample, packing, fim]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
