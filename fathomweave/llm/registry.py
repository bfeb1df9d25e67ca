"""The queries of this folder and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from fathomweave.llm import linededup, quality, sharding
from fathomweave.llm.fingerprints import op9_fingerprints
from fathomweave.llm.langid import op3_langid
from fathomweave.llm.mixing import op6_mixing
from fathomweave.llm.packing import op8_packing
from fathomweave.llm.repair import OP11_SQL, op11_repair
from fathomweave.llm.simhash import op1_simhash
from fathomweave.llm.token_store import op2_token_store
from fathomweave.llm.toxicity import op7_toxicity
from fathomweave.llm.variants import OP12_SQL, op12_variants
from fathomweave.llm.warc import OP13_SQL, op13_warc

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_store": op2_token_store,
    "op3_langid": op3_langid,
    "op4_quality": quality.op4_quality,
    "op5_sharding": sharding.op5_sharding,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_fingerprints": op9_fingerprints,
    "op10_line_dedup": linededup.op10_line_dedup,
    "op11_repair": op11_repair,
    "op12_variants": op12_variants,
    "op13_warc": op13_warc,
}

ORACLE_SQL = {
    "op4_quality": quality.OP4_SQL,
    "op5_sharding": sharding.oracle(),
    "op10_line_dedup": linededup.OP10_SQL,
    "op11_repair": OP11_SQL,
    "op12_variants": OP12_SQL,
    "op13_warc": OP13_SQL,
}
