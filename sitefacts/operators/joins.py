"""Joins with small rule tables, and joins by containment, as plain table work."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts into which a key that many rows share is split.
SALTS = 16


def salted_join(rows: DataFrame, rules: DataFrame, on: list[str], spread_by: Column, salts: int = SALTS) -> DataFrame:
    """Inner equi-join of many rows with a rule table in which each key is rare.

    A key may hold any share of ``rows``: these are dealt to ``salts`` parts by ``spread_by``, and
    each rule stands in every part. The hint keeps Spark from broadcasting ``rows``, which it would where
    it knows the size of neither side well; rules that are bounded may come with ``F.broadcast``, which
    goes before.
    """
    part = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    copies = rules.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", part).hint("merge").join(copies, [*on, "__salt"]).drop("__salt")


def contained_in(
    nodes: DataFrame, keys: list[str], outer: Column, inner: Column, nearest: bool = False
) -> DataFrame:
    """Pairs ``keys, outer_id, inner_id`` of nodes of a document where the one contains the other.

    ``nodes`` has a row per node with ``id`` in document order and ``end``, the id of its last
    descendant; ``keys`` name the document. An interval merge join: rows of a document pass in order
    beside the stack of outer nodes that are still open, so the work is one step per node and one per
    pair, and nothing but the stack is held. ``nearest`` gives the innermost outer node only. Ids or
    ends that are null are in no pair.
    """
    slim = nodes.select(*keys, "id", "end", outer.alias("__outer"), inner.alias("__inner"))
    slim = slim.filter(F.col("id").isNotNull() & F.col("end").isNotNull())
    dealt = slim.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "id", F.desc("end"))
    schema = ", ".join(f"`{k}` {nodes.schema[k].dataType.simpleString()}" for k in keys)
    kinds = [nodes.schema[k].dataType for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        fields = [pa.field(k, to_arrow_type(t)) for k, t in zip(keys, kinds, strict=True)]
        out = pa.schema([*fields, ("outer_id", pa.int64()), ("inner_id", pa.int64())])
        document, open_ = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            pairs = []
            for *key, id_, end, is_outer, is_inner in zip(*columns, strict=True):
                if key != document:
                    document, open_ = key, []
                while open_ and open_[-1][1] < id_:
                    open_.pop()
                if is_inner:
                    pairs += [(*key, o, id_) for o, _ in (open_[-1:] if nearest else open_)]
                if is_outer and end > id_:
                    open_.append((id_, end))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[i] for p in pairs], f.type) for i, f in enumerate(out)], schema=out
            )

    return dealt.mapInArrow(run, f"{schema}, outer_id long, inner_id long")
