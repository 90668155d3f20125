"""The named queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from splitclock.llm.bpe import bpe_query
from splitclock.llm.embed import ORACLE as EMBEDDING_SQL
from splitclock.llm.embed import embedding_query
from splitclock.llm.html_main import html_query
from splitclock.llm.langid import language_query
from splitclock.llm.ledger import ORACLE as LEDGER_SQL
from splitclock.llm.ledger import ledger_query
from splitclock.llm.merkle import ORACLE as MERKLE_SQL
from splitclock.llm.merkle import merkle_query
from splitclock.llm.packing import packing_query
from splitclock.llm.pii import pii_query
from splitclock.llm.quality import quality_query
from splitclock.llm.sharding import sharding_query
from splitclock.llm.simhash import simhash_query
from splitclock.llm.suffix import suffix_query
from splitclock.llm.trie import ORACLE as TRIE_SQL
from splitclock.llm.trie import trie_query

QUERIES = {
    "op1_embedding": embedding_query,
    "op2_language": language_query,
    "op3_bpe": bpe_query,
    "op4_suffix": suffix_query,
    "op5_sharding": sharding_query,
    "op6_quality": quality_query,
    "op9_html": html_query,
    "op10_pii": pii_query,
    "op7_packing": packing_query,
    "op8_simhash": simhash_query,
    "op11_trie": trie_query,
    "op12_ledger": ledger_query,
    "op13_merkle": merkle_query,
}

ORACLES: dict[str, str] = {"op1_embedding": EMBEDDING_SQL.strip(), "op11_trie": TRIE_SQL.strip(), "op12_ledger": LEDGER_SQL.strip(), "op13_merkle": MERKLE_SQL.strip()}
