"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from marketday.llm import decontamination, jaccard, line_dedup, merkle, neighbours, packing, quality, repeats, sharding, spelling, token_files, toxicity, urls
from marketday.llm.common import ready, table


def _over(name: str, digest, *more: str):
    def run(spark, sf_dir):
        return digest(*[table(ready(spark), sf_dir, t) for t in (name, *more)])

    return run


QUERIES = {
    "op1_repeats": _over("documents", repeats.digest),
    "op2_toxicity": _over("documents", toxicity.digest, "labels"),
    "op3_jaccard_join": _over("documents", jaccard.digest),
    "op4_quality": _over("documents", quality.digest, "labels"),
    "op5_neighbours": _over("embeddings", neighbours.digest),
    "op6_decontamination": _over("documents", decontamination.digest, "benchmark"),
    "op7_token_files": _over("documents", token_files.digest),
    "op8_packing": _over("documents", packing.digest),
    "op9_line_dedup": _over("documents", line_dedup.digest),
    "op10_sharding": _over("documents", sharding.digest),
    "op11_spelling": _over("documents", spelling.digest),
    "op12_merkle": _over("documents", merkle.digest),
    "op13_url_filter": _over("pages", urls.digest),
}
SQL = {"op9_line_dedup": line_dedup.SQL, "op11_spelling": spelling.SQL, "op12_merkle": merkle.SQL, "op13_url_filter": urls.SQL}
