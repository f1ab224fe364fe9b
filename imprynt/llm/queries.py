"""The thin queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from imprynt.llm import chat, collocations, decontaminate, fptree, langid, lines, oddsketch, packing, quality, secrets, simhash, syncmers, warc

MODULES = [warc, simhash, decontaminate, quality, lines, packing, secrets, chat, langid, syncmers, oddsketch, fptree, collocations]


def queries() -> dict:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in MODULES if getattr(m, "SQL", None)}
