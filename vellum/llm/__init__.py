"""Operators for preparing training text at corpus scale.

Ten operators (one module each), the queries that run them (``queries.py``) and their
DuckDB statements (``oracle.py``).  Nothing outside this package imports it.

| module        | operator                                   |
| near_dup      | MinHash near-duplicates, bottom-k sketches |
| licenses      | license scan by diagonal voting (native)   |
| substring     | repeated passages, FM-index per shard      |
| token_count   | token counts                               |
| packing       | bulk-synchronous best-fit packing          |
| exact_dedup   | exact copies against a digest index        |
| url_filter    | block lists with redirect equivalence      |
| decontaminate | benchmark passages, q-gram lemma           |
| toxicity      | weakly supervised toxicity scores          |
| secrets       | secret scan with a blob ledger (native)    |
"""
