"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import canonical, chat, exact, jaccard, lm, mixing, packing, puquality, sstable, substring
from .common import table


def queries() -> dict:
    docs = lambda spark, d: table(spark, d, "documents")
    return {
        "op1_quality": lambda s, d: puquality.quality(docs(s, d), table(s, d, "labels")),
        "op2_sstable": lambda s, d: sstable.shards(docs(s, d)),
        "op3_fingerprint": lambda s, d: canonical.fingerprints(docs(s, d)),
        "op4_chat": lambda s, d: chat.turns_and_unmapped(chat.as_records(table(s, d, "conversations"))),
        "op5_packing": lambda s, d: packing.pack(docs(s, d)),
        "op6_mixing": lambda s, d: mixing.mix(docs(s, d)),
        "op7_jaccard": lambda s, d: jaccard.links(docs(s, d)),
        "op8_exact": lambda s, d: exact.exact_duplicates(docs(s, d)),
        "op9_substring": lambda s, d: substring.passages(docs(s, d)),
        "op10_lm": lambda s, d: lm.score(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat": chat.ORACLE_SQL,
        "op6_mixing": mixing.ORACLE_SQL,
        "op8_exact": "SELECT doc_id, m AS duplicate_of FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS m FROM documents WHERE text IS NOT NULL) WHERE doc_id <> m",
    }
