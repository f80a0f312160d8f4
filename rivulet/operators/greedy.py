"""Greedy keep-first suppression over one or more similarity tiers.

Rows are visited in ``seq`` order; a row is dropped when it is similar to an
earlier row that was kept. A dropped row never suppresses another one, so the
result is the first maximal independent set of the similarity graph, not its
connected components.

The graph is never written out as a whole. Each tier supplies an index of
entries ``(key, id, seq, probe, base)``; two rows can only be similar if a probe
entry of one meets a base entry of the other under the same key. A round

1. finds the *ready* rows: those with at most ``heads`` earlier candidates under
   every key, and decides them exactly from their verified pairs;
2. sweeps the rows not ready against the rows just kept and drops the matches.

A group of near copies under one key therefore costs (rows x rows kept of it), not
(rows x rows). ``heads`` grows by ``GROWTH`` per round, so the number of rounds is
logarithmic in the longest key, and nothing is capped: the last round has all
rows ready.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import condense, discard, is_settled, settle
from .skew import FLOOR, if_small, join_skewed, meet_skewed

HEADS = 512
GROWTH = 16

PAIR = ["id", "other_id", "other_seq", "score"]


@dataclass(frozen=True)
class Tier:
    """One notion of similarity.

    ``index`` gives the ``entries``, or is a function that makes them when they are asked for. They hold ``key (long), id, seq, probe, base`` and any columns the
    tier needs to prune. ``pairs(later, earlier)`` returns the verified pairs
    ``(id, other_id, other_seq, score)`` with ``other_seq < seq``. In a symmetric
    tier the earlier row may be the probing one.

    Where equal values make rows similar, the entries also hold the ``value``, and
    ``lose(entries)`` gives the ids of the rows that are dropped, without forming pairs.

    A tier may compare whole blocks of rows in one task instead: then ``blocks (id, seq, ...)`` are
    what ``pairs`` takes, or a function that makes them; the index is not computed, and ``best(later, earlier, k)`` gives at least the k best
    pairs of every row. ``within(horizon)`` gives all pairs at most so many arrivals apart, with ``seq``.
    """

    name: str
    index: DataFrame | Callable[[], DataFrame]
    pairs: Callable[[DataFrame, DataFrame], DataFrame]
    symmetric: bool = False
    lose: Callable[[DataFrame], DataFrame] | None = None
    blocks: DataFrame | Callable[[], DataFrame] | None = None
    best: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None
    within: Callable[[int], DataFrame] | None = None

    @property
    def entries(self) -> DataFrame:
        return self.index() if callable(self.index) else self.index

    @property
    def rows(self) -> DataFrame:
        """What ``pairs`` is called with."""
        if self.blocks is None:
            return self.entries
        return self.blocks() if callable(self.blocks) else self.blocks

    def over(self, rows: DataFrame) -> Tier:
        """The tier with these rows in place of its own."""
        return replace(self, **{"index" if self.blocks is None else "blocks": rows})


def candidates(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """``(id, other_id, other_seq)`` where the later row probes a base entry of the earlier one."""
    left = later.where("probe").select("key", "id", "seq")
    right = earlier.where("base").select("key", F.col("id").alias("other_id"), F.col("seq").alias("other_seq"))
    met = meet_skewed(left, right, "key", "id", "other_id").where("other_seq < seq")
    return met.select("id", "other_id", "other_seq").distinct()


def counted_candidates(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Like ``candidates`` for entries with ``size`` and ``hits``, either row probing.

    The row of smaller size probes and has to meet the other one under at least
    ``hits`` keys.
    """
    left = later.select("key", "id", "seq", "probe", "base", "size", "hits")
    right = earlier.select(*[F.col(c).alias(c if c == "key" else f"other_{c}") for c in left.columns])

    def meet(lhs: DataFrame, rhs: DataFrame, fits: Column, hits: str) -> DataFrame:
        met = meet_skewed(lhs, rhs, "key", "id", "other_id").where((F.col("other_seq") < F.col("seq")) & fits)
        per_pair = met.groupBy("id", "other_id", "other_seq")
        return per_pair.agg(F.count(F.lit(1)).alias("n"), F.max(hits).alias("hits")).where("n >= hits")

    size, other = F.col("size"), F.col("other_size")
    own = meet(left.where("probe"), right.where("other_base"), size <= other, "hits")
    its = meet(left.where("base"), right.where("other_probe"), other < size, "other_hits")
    return own.unionByName(its).select("id", "other_id", "other_seq")


def attach(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """Pairs with the payload columns of both rows (those of the earlier one as ``other_*``).

    An earlier row can be the candidate of very many rows, so that side is joined
    safe for skew.
    """
    pairs = settle(pairs)
    names = [c for c in payload.columns if c != "id"]
    other = payload.select(F.col("id").alias("other_id"), *[F.col(c).alias(f"other_{c}") for c in names])
    return join_skewed(pairs, other, "other_id", F.col("id")).join(payload, "id")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _not_ready(tiers: list[Tier], entries: list[DataFrame], heads: int) -> DataFrame | None:
    """Ids with more than ``heads`` earlier candidates under some key; None if there are none."""
    # A key with few probes or few bases has few pairs: all its rows are ready.
    hot = _union([
        e.groupBy("key").agg(F.count_if("probe").alias("np"), F.count_if("base").alias("nb"))
        .where((F.col("np") > heads) & (F.col("nb") > heads)).select(F.lit(i).alias("tier"), "key")
        for i, e in enumerate(entries)
    ])
    hot = settle(hot)
    if hot.isEmpty():
        return None
    late = []
    first = Window.partitionBy("key").orderBy("seq")
    for i, (tier, e) in enumerate(zip(tiers, entries)):
        crowded = e.join(if_small(hot.where(F.col("tier") == i).select("key")), "key", "left_semi")

        def limit(role: str) -> DataFrame:
            head = crowded.where(role).select("key", "seq").withColumn("r", F.row_number().over(first))
            return head.where(F.col("r") <= heads).groupBy("key").agg(F.max("seq").alias("limit_seq"))

        def beyond(role: str, met: str) -> DataFrame:
            rows = crowded.where(role).select("key", "id", "seq")
            return rows.join(if_small(settle(limit(met))), "key").where(F.col("seq") > F.col("limit_seq")).select("id")

        late.append(beyond("probe", "base"))
        if tier.symmetric:
            late.append(beyond("base", "probe"))
    late = settle(_union(late).distinct())
    return None if late.isEmpty() else late


def resolve(pairs: DataFrame, waiting: DataFrame | None = None) -> DataFrame:
    """Decide the rows of a pair table: ``(id, kept)`` for every decidable ``id``.

    ``pairs`` holds ``(id, other_id)`` with the other row earlier. Rows without a
    pair are not listed: they are kept. ``waiting`` are rows whose fate is open.
    """
    edges = settle(pairs.select("id", "other_id").distinct())
    n_edges = edges.count()
    decided: list[DataFrame] = []
    # Earlier rows that have no pair of their own and do not wait are kept.
    fresh = edges.select(F.col("other_id").alias("id")).distinct().join(edges.select("id"), "id", "left_anti")
    if waiting is not None:
        fresh = fresh.join(waiting, "id", "left_anti")
    fresh = fresh.select("id", F.lit(True).alias("kept"))
    while True:
        known = fresh.select(F.col("id").alias("other_id"), "kept")
        # One kept row can stand against very many others.
        judged = join_skewed(edges, known, "other_id", F.col("id"), "left") if n_edges > FLOOR else edges.join(
            known, "other_id", "left")
        per_id = judged.groupBy("id").agg(
            F.bool_or(F.coalesce("kept", F.lit(False))).alias("hit"), F.count_if(F.col("kept").isNull()).alias("open"))
        # A judged pair is spent: its earlier row is dropped, or the id is decided.
        step = settle(judged.join(per_id, "id").withColumn("done", F.col("hit") | (F.col("open") == 0)))
        n_done, n_open = step.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
        if not n_done:
            break
        fresh = step.where("done").select("id", (~F.col("hit")).alias("kept")).distinct()
        decided.append(fresh)
        if not n_open:
            break
        n_edges = n_open
        edges = step.where(~F.col("done") & F.col("kept").isNull()).select("id", "other_id")
    return _union(decided) if decided else edges.select("id", F.lit(True).alias("kept")).limit(0)


def keep_first(rows: DataFrame, tiers: list[Tier], heads: int = HEADS,
               decide: Callable[..., DataFrame] = resolve, columns: tuple[str, ...] = ("id", "other_id")) -> DataFrame:
    """``(id, seq, kept)`` for every row of ``rows (id, seq[, copy_key])``.

    Rows sharing a non-null ``copy_key`` are identical for all tiers and similar
    to each other: all but the first are dropped without entering the index.
    ``decide`` turns pairs, of which it needs ``columns``, into verdicts.
    """
    if "copy_key" in rows.columns:
        firsts = (
            rows.where(F.col("copy_key").isNotNull())
            .groupBy("copy_key")
            .agg(F.min(F.struct("seq", "id")).alias("f"))
            .select("f.id", "f.seq")
        )
        open_rows = settle(firsts.unionByName(rows.where(F.col("copy_key").isNull()).select("id", "seq")))
        among = if_small(open_rows.select("id"))
        entries = [settle(t.rows.join(among, "id", "left_semi")) for t in tiers]
    else:
        open_rows = rows.select("id", "seq")
        entries = [t.rows for t in tiers]
    dropped: list[DataFrame] = []
    if any(t.blocks is not None for t in tiers):
        dropped = _in_order(open_rows, tiers, entries, heads, decide, columns, "copy_key" in rows.columns)
        return _with_copies(rows, open_rows, dropped)
    by_value = decide is resolve and all(t.lose for t in tiers)
    if by_value:
        named = [e.withColumn("value", F.concat_ws(":", F.lit(str(i)), "value")) for i, e in enumerate(entries)]
        dropped.append(tiers[0].lose(_union(named)))
    while not by_value:
        late = _not_ready(tiers, entries, heads)
        if late is None:
            pairs = _union([t.pairs(e, e).select(*columns) for t, e in zip(tiers, entries)])
            verdict = decide(pairs)
            dropped.append(verdict.where(~F.col("kept")).select("id"))
            break
        ready = [e.join(late, "id", "left_anti") for e in entries]
        pairs = settle(_union([t.pairs(r, e).select(*columns) for t, r, e in zip(tiers, ready, entries)]))
        verdict = settle(decide(pairs, waiting=late))
        lost = verdict.where(~F.col("kept")).select("id")
        # Not decided: the late rows, and ready rows that hang on a late one.
        hanging = pairs.select("id").distinct().join(verdict, "id", "left_anti")
        undecided = settle(late.unionByName(hanging))
        still = [e.join(undecided, "id", "left_semi") for e in entries]
        new_kept = [e.join(undecided, "id", "left_anti").join(lost, "id", "left_anti") for e in entries]
        swept = settle(
            _union([t.pairs(s, k).select("id") for t, s, k in zip(tiers, still, new_kept)]).distinct()
        )
        dropped += [lost, swept]
        entries = [settle(s.join(swept, "id", "left_anti")) for s in still]
        heads *= GROWTH
    return _with_copies(rows, open_rows, dropped)


def matched(tiers: list[Tier], later: list[DataFrame], earlier: list[DataFrame]) -> DataFrame:
    """Ids of the later rows that match an earlier one under some tier; a tier is not asked about rows that one before it has found."""
    found: list[DataFrame] = []
    for tier, new, old in zip(tiers, later, earlier):
        new = reduce(lambda left, gone: left.join(if_small(gone), "id", "left_anti"), found, new)
        found.append(settle(tier.pairs(new, old).select("id").distinct()))
    return _union(found)


def _in_order(open_rows: DataFrame, tiers: list[Tier], entries: list[DataFrame], heads: int, decide: Callable[..., DataFrame],
              columns: tuple[str, ...], own: bool = False) -> list[DataFrame]:
    """Ids of the dropped rows, in several tables. ``own``: nobody else reads the entries, which go when they are no longer needed.

    The first ``heads`` rows are decided from their pairs, and what is similar to those kept is dropped from the rest; then come the
    first of what is left, ``GROWTH`` times as many, until there is none. A group of near copies costs rows x kept here too.
    """
    dropped: list[DataFrame] = []
    while True:
        left = open_rows.agg(F.count("seq")).first()[0]
        cut = open_rows.agg(F.percentile_approx("seq", heads / left, 1_000_000)).first()[0] if left > heads else None
        head = entries if cut is None else [settle(e.where(F.col("seq") <= cut)) for e in entries]
        pairs = _union([t.pairs(h, h).select(*columns) for t, h in zip(tiers, head)])
        lost = settle(decide(pairs).where(~F.col("kept")).select("id"))
        dropped.append(lost)
        if cut is None:
            discard(*(entries if own else []))
            return dropped
        gone = if_small(lost)
        kept = [settle(h.join(gone, "id", "left_anti")) for h in head]
        rest = [e.where(F.col("seq") > cut) for e in entries]
        swept = settle(matched(tiers, rest, kept))
        discard(*kept, *head)
        dropped.append(swept)
        gone = if_small(swept)
        before, entries = entries, [settle(r.join(gone, "id", "left_anti")) for r in rest]
        discard(*(before if own else []))
        own = True
        open_rows = settle(open_rows.where(F.col("seq") > cut).join(gone, "id", "left_anti"))
        heads *= GROWTH


def _with_copies(rows: DataFrame, open_rows: DataFrame, dropped: list[DataFrame]) -> DataFrame:
    """The verdict on all rows: copies of a first row are dropped with it."""
    lost = _union(dropped).distinct().withColumn("lost", F.lit(True))
    kept_first = open_rows.join(lost, "id", "left").select("id", "seq", F.col("lost").isNull().alias("kept"))
    if "copy_key" not in rows.columns:
        return kept_first
    return (
        rows.select("id", "seq")
        .join(kept_first.select("id", "kept"), "id", "left")
        .withColumn("kept", F.coalesce("kept", F.lit(False)))
    )


def evidence(decisions: DataFrame, tiers: list[Tier], best: int = 0) -> DataFrame:
    """All verified pairs of a row with an earlier *kept* row: ``id, other_id, other_seq, score, tier, rank``.

    With ``best`` a tier may leave out what is not among the best so many of a row, and is not asked about rows that a tier before it has matched.

    Kept rows are not similar to each other, so a group of near copies holds few
    of them and the result stays linear in the number of rows.
    """
    kept, lost = decisions.where("kept").select("id"), decisions.where(~F.col("kept")).select("id")
    parts = []
    kept, lost = if_small(kept), if_small(lost)
    for rank, tier in enumerate(tiers):
        later, earlier = tier.rows.join(lost, "id", "left_semi"), tier.rows.join(kept, "id", "left_semi")
        pairs = tier.best(later, earlier, best) if best and tier.best else tier.pairs(later, earlier)
        if best and rank + 1 < len(tiers):
            pairs = settle(pairs)
            lost = if_small(settle(lost.join(if_small(pairs.select("id").distinct()), "id", "left_anti")))
        parts.append(pairs.select(*PAIR, F.lit(tier.name).alias("tier"), F.lit(rank).alias("rank")))
    return _union(parts)


def best_match(pairs: DataFrame) -> DataFrame:
    """Per row the lowest tier, then the highest score, then the earliest other row."""
    order = F.struct("rank", (-F.col("score")).alias("down"), "other_seq")
    best = F.min_by(F.struct("tier", F.col("other_id").alias("matched_id"), "score"), order)
    return pairs.groupBy("id").agg(best.alias("m")).select("id", "m.tier", "m.matched_id", "m.score")


def settled(tiers: list[Tier]) -> list[Tier]:
    """The tiers with their indexes computed once, for several uses."""
    return [t.over(rows if is_settled(rows := t.rows) else settle(rows)) for t in tiers]


def suppress(rows: DataFrame, tiers: list[Tier], heads: int = HEADS) -> DataFrame:
    """``id, seq, kept, tier, matched_id, score``: the greedy decision and its evidence."""
    tiers = settled(tiers)
    rows = settle(rows)
    spark = rows.sparkSession
    decisions = condense(spark, lambda: keep_first(rows, tiers, heads))
    why = condense(spark, lambda: best_match(evidence(decisions, tiers, best=1)))
    return decisions.join(why, "id", "left")
