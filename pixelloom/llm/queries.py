"""The corpus operators' registered queries and their SQL."""

from __future__ import annotations

from . import bpe, jaccard_join, line_dedup, packing, pii, quality, sharding, site_quality, warc, weighted_sampling
from .common import ship


def _shipped(f):
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


QUERIES = {
    f.__name__: _shipped(f)
    for f in (
        warc.op1_warc_salvage,
        weighted_sampling.op2_weighted_sampling,
        bpe.op3_byte_bpe,
        line_dedup.op4_line_dedup,
        pii.op5_pii_spans,
        sharding.op6_feistel_shards,
        site_quality.op7_site_quality,
        jaccard_join.op8_jaccard_join,
        quality.op9_quality_rules,
        packing.op10_pack_windows,
    )
}

ORACLES = {
    "op1_warc_salvage": warc.OP1_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op8_jaccard_join": jaccard_join.OP8_SQL,
}
