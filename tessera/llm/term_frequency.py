"""Frequency of every distinct value or term.

Method: burst-trie counting. Rows are first reduced to one for each record and term, so that a term counts once for
each record; every worker accumulates occurrences and records in a compact trie whose containers burst when they grow. Subtrees are then routed by prefixes that adapt to the terms (frequent
prefixes are longer) and matching subtrees of different workers are merged.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold_term

#: Terms a container holds before it bursts into one container for each next character.
BURST = 512
#: Routes for subtrees at most, and terms of the bounded sample they are planned from.
MAX_ROUTES, ROUTE_SAMPLE = 4096, 20_000
#: Terms a worker's tries take before their subtrees are sent on and it begins anew.
HELD_TERMS = 500_000


class BurstTrie:
    """Terms with an occurrence and a record counter each, in containers keyed by a shared prefix."""

    __slots__ = ("burst", "kids", "rows", "end")

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.kids: dict[str, BurstTrie] | None = None
        self.rows: dict[str, list[int]] = {}
        self.end: list[int] | None = None

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, at = self, 0
        while node.kids is not None:
            if at == len(term):
                if node.end is None:
                    node.end = [0, 0]
                node.end[0] += occurrences
                node.end[1] += records
                return
            c = term[at]
            node = node.kids.get(c) or node.kids.setdefault(c, BurstTrie(self.burst))
            at += 1
        rest = term[at:]
        held = node.rows.get(rest)
        if held is None:
            node.rows[rest] = [occurrences, records]
            if len(node.rows) > node.burst:
                node._burst()
        else:
            held[0] += occurrences
            held[1] += records

    def _burst(self) -> None:
        rows, self.rows, self.kids = self.rows, {}, {}
        for rest, (o, r) in rows.items():
            if rest:
                kid = self.kids.get(rest[0]) or self.kids.setdefault(rest[0], BurstTrie(self.burst))
                kid.rows[rest[1:]] = [o, r]
            else:
                self.end = [o, r]

    def items(self, prefix: str = ""):
        stack = [(prefix, self)]
        while stack:
            p, node = stack.pop()
            if node.end is not None:
                yield p, node.end
            for rest, counts in node.rows.items():
                yield p + rest, counts
            for c, kid in (node.kids or {}).items():
                stack.append((p + c, kid))


def plan_routes(sample: list[str], routes: int = MAX_ROUTES) -> list[str]:
    """Prefixes, sorted: every term goes to the last one not after it. Prefixes that many of the sample share are longer."""
    terms = sorted(set(sample))
    step = max(1, len(terms) // routes)
    cuts, previous = {""}, ""
    for term in terms[step::step]:
        k = 0
        while k < min(len(term), len(previous)) and term[k] == previous[k]:
            k += 1
        cuts.add(term[: k + 1])
        previous = term
    return sorted(cuts)


def term_counts(rows: DataFrame, fields: list[str], record: str, parts: int | None = None) -> DataFrame:
    """``field_name, term, occurrences, records``: every distinct folded value of the fields.

    Null, blank and ``<unk>`` are no terms. Occurrences are rows, records distinct values of ``record``; rows without
    one count as occurrences and as no record. An empty table gives no rows; repeated rows count as often as they occur.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = [F.xxhash64(F.lit(1), record).alias("r1"), F.xxhash64(F.lit(2), F.reverse(F.col(record).cast("string"))).alias("r2"), F.col(record).isNotNull().alias("has")]
    found = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), fold_term(f).alias("term")) for i, f in enumerate(fields)]))
    long = rows.select(*ids, found.alias("x")).select("r1", "r2", "has", "x.*").where("term is not null")
    # the sample of terms: bounded, and only for balance; all rows are counted
    chosen = long.where("pmod(r1, 64) = 0").select("term").limit(ROUTE_SAMPLE).toArrow()
    routes = plan_routes(chosen.column(0).to_pylist())
    # a row for each record and term; repetitions are merged before the shuffle, and neither a record nor a term of many rows is one task's
    pairs = long.groupBy("r1", "r2", "has", "field", "term").agg(F.count("*").alias("n"))
    names = ["field", "route", "terms", "occurrences", "records"]
    schema = "field int, route int, terms array<string>, occurrences array<long>, records array<long>"

    def accumulate(batches):
        tries, taken = [BurstTrie() for _ in fields], 0
        for batch in batches:
            if taken > HELD_TERMS:
                yield from _subtrees(tries, routes, names)
                tries, taken = [BurstTrie() for _ in fields], 0
            t = pa.table({"field": batch.column("field"), "term": batch.column("term"), "n": batch.column("n"), "r": batch.column("has").cast(pa.int64())})
            t = t.group_by(["field", "term"]).aggregate([("n", "sum"), ("r", "sum")])
            taken += t.num_rows
            for field, term, n, r in zip(*(t.column(c).to_pylist() for c in ("field", "term", "n_sum", "r_sum"))):
                tries[field].add(term, n, r)
        yield from _subtrees(tries, routes, names)

    def merge(batches):
        # subtrees come route by route, so one trie is held at a time
        at, trie = None, BurstTrie()
        for batch in batches:
            for field, route, terms, occ, rec in zip(*(c.to_pylist() for c in batch.columns)):
                if (field, route) != at:
                    if at is not None:
                        yield _merged(at[0], trie)
                    at, trie = (field, route), BurstTrie()
                for term, o, r in zip(terms, occ, rec):
                    trie.add(term, o, r)
        if at is not None:
            yield _merged(at[0], trie)

    trees = pairs.select("field", "term", "n", "has").mapInArrow(accumulate, schema)
    merged = trees.repartition(parts, "field", "route").sortWithinPartitions("field", "route").mapInArrow(merge, "field int, term string, occurrences long, records long")
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)
    return merged.select(name.alias("field_name"), "term", "occurrences", "records")


def _merged(field: int, trie: BurstTrie) -> pa.RecordBatch:
    got = list(trie.items())
    columns = [pa.array([field] * len(got), pa.int32()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1][0] for g in got], pa.int64()), pa.array([g[1][1] for g in got], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["field", "term", "occurrences", "records"])


def _subtrees(tries: list[BurstTrie], routes: list[str], names: list[str]):
    """The tries cut along the routes, as one row of terms and counters for each."""
    import bisect

    for field, trie in enumerate(tries):
        cut: dict[int, list] = {}
        for term, (o, r) in trie.items():
            cut.setdefault(bisect.bisect_right(routes, term) - 1, []).append((term, o, r))
        if cut:
            cols = [[list(c) for c in zip(*v)] for v in cut.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([field] * len(cut), pa.int32()), pa.array(list(cut), pa.int32()), pa.array([c[0] for c in cols], pa.list_(pa.string())), pa.array([c[1] for c in cols], pa.list_(pa.int64())), pa.array([c[2] for c in cols], pa.list_(pa.int64()))],
                names=names,
            )


def marked_terms(rows: DataFrame, fields: list[str], record: str, rare: int = 2, common: float = 0.05) -> DataFrame:
    """``field_name, term, occurrences, records, mark``: mark is ``rare`` in at most ``rare`` records, ``common`` in more than that share of all records, else null.

    All records are the distinct non-null values of ``record`` in the table. A term that is both counts as rare.
    """
    counts = term_counts(rows, fields, record)
    total = rows.select(F.col(record).alias("_r")).agg(F.count_distinct("_r").alias("total"))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * total.scalar(), "common")
    return counts.select("field_name", "term", "occurrences", "records", mark.alias("mark"))
