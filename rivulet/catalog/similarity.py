"""Queries on similarity: pairs with kept messages, greedy suppression, the whole curation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import common, greedy, horizon, images as I, keys, stems, vectors, words
from ..operators.reports import outcome_stats as count_outcomes
from ..operators.reports import top_per_group
from ..operators.select import mark_repeats
from ..operators.skew import if_small
from ..plans.curate import Dims, curate as run_curate
from ..schema import Options
from ..session import condense, settle
from ..sources.tables import spread_small
from .base import IMAGES, REMOVED, images, removed_texts, signed, table, texts
from .ordering import _STRIP

QUERIES: dict = {}
SQL: dict = {}
VECTOR_THRESHOLD = 0.4


def _register(name: str, sql: str):
    def add(fn):
        QUERIES[name] = fn
        SQL[name] = sql
        return fn
    return add


# --- SQL building blocks: all pairs by brute force, then the serial greedy pass -------------------

def _word_sql(src: str) -> str:
    return rf"""
w AS MATERIALIZED (SELECT id, list_distinct(list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}]+'),
  lambda x: x <> '')) AS words, length(text) AS len FROM {src}),
tok AS MATERIALIZED (SELECT id, unnest(words) AS t FROM w),
co AS MATERIALIZED (SELECT a.id, b.id AS other_id, count(*) AS c FROM tok a JOIN tok b ON a.t = b.t AND b.id < a.id GROUP BY ALL),
overlap AS MATERIALIZED (SELECT co.id, co.other_id, a.len, c / greatest(8, least(len(a.words), len(b.words))) AS score,
  c = len(a.words) AND c = len(b.words) AS same FROM co JOIN w a ON a.id = co.id JOIN w b ON b.id = co.other_id)"""


def _stem_sql(src: str) -> str:
    m = "((length(a.text) * 4) // 5 + 1)"
    core = f"substr(a.text, length(a.text) - {m} + 1, 2 * {m} - length(a.text))"
    return f"""
runs AS MATERIALIZED (SELECT a.id, b.id AS other_id FROM {src} a JOIN {src} b ON b.id < a.id
  WHERE length(a.text) > 10 AND length(b.text) > 0 AND contains(b.text, {core}) AND len(list_filter(
    range(1, length(a.text) - {m} + 2), lambda i: contains(b.text, substr(a.text, i, {m})))) > 0)"""


def _vector_sql(threshold: float, guard: str = "true") -> str:
    return f"""
v AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
dots AS MATERIALIZED (SELECT * FROM (SELECT a.id, b.id AS other_id, list_dot_product(a.e, b.e) AS score
  FROM v a JOIN v b ON b.id < a.id) WHERE score > {threshold} AND {guard})"""


_GREEDY = """
ord AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT DISTINCT id FROM edges)),
g AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS lost UNION ALL
  SELECT g.n + 1, CASE WHEN bool_or(NOT list_contains(g.lost, e.other_id)) THEN list_append(any_value(g.lost), any_value(e.id))
    ELSE any_value(g.lost) END
  FROM g JOIN ord ON ord.n = g.n + 1 JOIN edges e ON e.id = ord.id GROUP BY g.n),
lost AS MATERIALIZED (SELECT unnest(lost) AS id FROM (SELECT lost FROM g ORDER BY n DESC LIMIT 1)),
proof AS MATERIALIZED (SELECT e.* FROM edges e WHERE e.id IN (SELECT id FROM lost) AND e.other_id NOT IN (SELECT id FROM lost)),
why AS MATERIALIZED (SELECT id, tier, other_id AS matched_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (
  PARTITION BY id ORDER BY rank, score DESC, other_id) AS r FROM proof) WHERE r = 1)"""

_WORD_EDGES = "SELECT id, other_id, score, 'words' AS tier, 0 AS rank FROM overlap WHERE score > 0.7 OR same"
_WORDS_KEPT = f"WITH RECURSIVE {_word_sql('(SELECT doc_id AS id, text FROM documents)')}, edges AS MATERIALIZED ({_WORD_EDGES}), {_GREEDY}"


def _shown(decisions):
    return decisions.where(~F.col("kept")).select("id", "tier", "matched_id", F.round("score", 6).alias("score"))


# --- words -----------------------------------------------------------------------------------------

def _word_history(spark, sf):
    rows = texts(spark, sf)
    (tier,) = greedy.settled([words.overlap_tier(rows)])
    return rows, tier, condense(spark, lambda: greedy.keep_first(settle(words.keyed_rows(rows)), [tier]))


@_register("word_set_equal", r"""
WITH w AS (SELECT doc_id AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'),
  lambda x: x <> ''))) AS words FROM documents)
SELECT id, id = min(id) OVER (PARTITION BY words) AS kept, min(id) OVER (PARTITION BY words) AS first_seq FROM w
WHERE len(words) > 0""")
def word_set_equal(spark, sf):
    sets = words.word_sets(texts(spark, sf))
    return mark_repeats(sets, words.set_key(F.col("words"))).select("id", "kept", "first_seq")


@_register("word_overlap_pairs", f"{_WORDS_KEPT} SELECT id, other_id, round(score, 6) AS score FROM proof")
def word_overlap_pairs(spark, sf):
    _, tier, decisions = _word_history(spark, sf)
    return greedy.evidence(decisions, [tier]).select("id", "other_id", F.round("score", 6).alias("score"))


_WORD_TOP = f"""{_WORDS_KEPT}, ranked AS (SELECT id, other_id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY id ORDER BY score DESC, other_id) AS rank FROM overlap
  WHERE score > 0.5 AND other_id NOT IN (SELECT id FROM lost))"""


def _word_matches(spark, sf, best: int, floor: float = Options().overlap_report_floor):
    """Overlap above ``floor`` of every message with the earlier kept ones, the ``best`` at least."""
    rows, _, decisions = _word_history(spark, sf)
    wide = words.overlap_tier(rows, threshold=floor, equal_sets=False)
    sets, kept = settle(wide.rows), decisions.where("kept").select("id")
    # Two tables without a common row: the kept rows among themselves, the others against them.
    first, rest = (settle(sets.join(if_small(kept), "id", how)) for how in ("left_semi", "left_anti"))
    return wide.best(first, first, best).unionByName(wide.best(rest, first, best))


@_register("word_overlap_best", f"{_WORD_TOP} SELECT id, other_id, score FROM ranked WHERE rank = 1")
def word_overlap_best(spark, sf):
    best = F.max_by(F.struct("other_id", "score"), F.struct("score", (-F.col("other_id")).alias("early")))
    found = _word_matches(spark, sf, 1).groupBy("id").agg(best.alias("b"))
    return found.select("id", "b.other_id", F.round("b.score", 6).alias("score"))


@_register("word_overlap_top3", f"{_WORD_TOP} SELECT id, CAST(rank AS INTEGER) AS rank, other_id, score FROM ranked WHERE rank <= 3")
def word_overlap_top3(spark, sf):
    top = top_per_group(_word_matches(spark, sf, 3), ["id"], [F.desc("score"), F.col("other_id")], 3)
    return top.select("id", "rank", "other_id", F.round("score", 6).alias("score"))


@_register("word_overlap_dedup", f"{_WORDS_KEPT} SELECT id, tier, matched_id, score FROM why")
def word_overlap_dedup(spark, sf):
    rows = texts(spark, sf)
    return _shown(greedy.suppress(words.keyed_rows(rows), [words.overlap_tier(rows)]))


# --- common runs -------------------------------------------------------------------------------------

_DOCS_TEXT = "(SELECT doc_id AS id, text FROM documents)"


@_register("stem_dup_pairs", f"""WITH RECURSIVE {_stem_sql(_DOCS_TEXT)},
edges AS MATERIALIZED (SELECT id, other_id, 1.0::DOUBLE AS score, 'stem' AS tier, 0 AS rank FROM runs), {_GREEDY}
SELECT id, other_id FROM proof""")
def stem_dup_pairs(spark, sf):
    rows = texts(spark, sf)
    (tier,) = greedy.settled([stems.stem_tier(rows)])
    decisions = condense(spark, lambda: greedy.keep_first(settle(stems.keyed_rows(rows)), [tier]))
    return greedy.evidence(decisions, [tier]).select("id", "other_id")


@_register("common_stem_group", """
WITH h AS (SELECT conv_id, arg_min(text, turn) AS first, min(turn) AS o FROM conversations GROUP BY 1),
m AS (SELECT h.conv_id, first, list(c.text) AS others FROM h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn > h.o GROUP BY ALL),
p AS (SELECT conv_id, first, others, unnest(range(1, length(first) + 1)) AS i FROM m),
l AS (SELECT conv_id, first, i, list_reduce([0, 2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1], lambda n, s:
  CASE WHEN i + n + s - 1 <= length(first) AND len(list_filter(others, lambda o: NOT contains(o, substr(first, i, n + s)))) = 0
  THEN n + s ELSE n END) AS n FROM p),
b AS (SELECT conv_id, arg_max(substr(first, i, n), n * 100000 - i) AS stem FROM l WHERE n >= 5 GROUP BY 1)
SELECT h.conv_id, coalesce(b.stem, '') AS stem FROM h LEFT JOIN b USING (conv_id)""")
def common_stem_group(spark, sf):
    turns = spread_small(table(spark, sf, "conversations"))
    return common.common_stem(turns, "conv_id", "turn", "text")


# DuckDB measures bytes, Spark characters: there each non-ASCII letter becomes a sign that no text uses.
@_register("levenshtein_pairs", """
WITH t AS (SELECT conv_id, turn, translate(text, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', '!"#$%&()*+-/0123456789') AS text FROM conversations)
SELECT a.conv_id, a.turn, CAST(levenshtein(a.text, b.text) AS INTEGER) AS distance
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""")
def levenshtein_pairs(spark, sf):
    turns = spread_small(table(spark, sf, "conversations"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    both = turns.join(before, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.levenshtein("text", "before").alias("distance"))


# --- vectors -----------------------------------------------------------------------------------------

_VECTORS_KEPT = f"""WITH RECURSIVE {_vector_sql(VECTOR_THRESHOLD)},
edges AS MATERIALIZED (SELECT id, other_id, score, 'embedding' AS tier, 0 AS rank FROM dots), {_GREEDY}"""


def _embeddings(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"),
                                                 F.col("embedding").alias("vec"))
    return spread_small(rows)


def _vector_history(spark, sf):
    rows = _embeddings(spark, sf)
    (tier,) = greedy.settled([vectors.vector_tier(rows, VECTOR_THRESHOLD)])
    return rows, condense(spark, lambda: greedy.keep_first(settle(vectors.keyed_rows(rows, VECTOR_THRESHOLD)), [tier])).where("kept")


@_register("embedding_dup", f"{_VECTORS_KEPT} SELECT id, tier, matched_id, score FROM why")
def embedding_dup(spark, sf):
    rows = _embeddings(spark, sf)
    tier = vectors.vector_tier(rows, VECTOR_THRESHOLD)
    return _shown(greedy.suppress(vectors.keyed_rows(rows, VECTOR_THRESHOLD), [tier]))


@_register("embedding_top1", f"""{_VECTORS_KEPT}, s AS (SELECT a.id, b.id AS other_id, list_dot_product(a.e, b.e) AS score
  FROM v a JOIN v b ON b.id < a.id WHERE b.id NOT IN (SELECT id FROM lost)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other_id) AS rank FROM s WHERE score > 0.2)
SELECT id, other_id, round(score, 6) AS score FROM r WHERE rank = 1""")
def embedding_top1(spark, sf):
    rows, history = _vector_history(spark, sf)
    top = vectors.nearest(rows, history, k=1, floor=Options().embedding_report_floor, earlier_only=True)
    return top.select("id", "other_id", F.round("score", 6).alias("score"))


@_register("embedding_knn", f"""{_VECTORS_KEPT}, s AS (SELECT a.id, b.id AS other_id, list_dot_product(a.e, b.e) AS score
  FROM v a JOIN v b ON b.id <> a.id WHERE b.id NOT IN (SELECT id FROM lost)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other_id) AS rank FROM s WHERE score > 0.28)
SELECT id, CAST(rank AS INTEGER) AS rank, other_id, round(sqrt(2 - 2 * score), 5) AS distance FROM r WHERE rank <= 3""")
def embedding_knn(spark, sf):
    # Unit vectors: a distance of at most 1.2 is a dot product of at least 0.28.
    rows, history = _vector_history(spark, sf)
    top = vectors.nearest(rows, history, k=3, floor=0.28, earlier_only=False)
    return top.select("id", "rank", "other_id", F.round(F.sqrt(2 - 2 * F.col("score")), 5).alias("distance"))


# --- images and keys -----------------------------------------------------------------------------------

@_register("photo_id_dedup", f"""WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id AS id, n_chars AS photo_id, md5(text) AS hash FROM documents),
edges AS MATERIALIZED (SELECT a.id, b.id AS other_id, 1.0::DOUBLE AS score, 'photo' AS tier, 0 AS rank FROM p a JOIN p b
  ON b.id < a.id AND (a.photo_id = b.photo_id OR a.hash = b.hash)), {_GREEDY}
SELECT id, tier, matched_id, score FROM why""")
def photo_id_dedup(spark, sf):
    photos = spread_small(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), F.col("n_chars").alias("photo_id"),
        F.md5("text").alias("hash"))
    return _shown(greedy.suppress(photos.select("id", "seq"), [keys.key_tier(photos, ["photo_id", "hash"], "photo")]))


_SSIM = f"""im AS MATERIALIZED (SELECT * FROM {IMAGES}),
corner AS (SELECT unnest([0, 1, 8, 9]) AS c),
win AS MATERIALIZED (SELECT id, c, m, list_transform(px, lambda p: p - m) AS d FROM (SELECT id, c, px, list_avg(px) AS m FROM (
  SELECT id, c, list_transform(range(49), lambda k: gray[CAST(1 + c + (k // 7) * 8 + k % 7 AS BIGINT)]) AS px FROM im, corner))),
wv AS MATERIALIZED (SELECT *, list_dot_product(d, d) / 48 AS var FROM win),
sim AS MATERIALIZED (SELECT a.id, b.id AS other_id, avg((2 * a.m * b.m + 6.5025) / (a.m * a.m + b.m * b.m + 6.5025)
  * (2 * list_dot_product(a.d, b.d) / 48 + 58.5225) / (a.var + b.var + 58.5225)) AS score
  FROM wv a JOIN wv b ON a.c = b.c AND b.id < a.id GROUP BY ALL)"""


@_register("image_dup_pairs", f"""WITH RECURSIVE {_SSIM}, edges AS MATERIALIZED (
  SELECT id, other_id, score, 'image' AS tier, 0 AS rank FROM sim WHERE round_even(score, 2) > 0.9), {_GREEDY}
SELECT id, tier, matched_id, round(score, 4) AS score FROM why""")
def image_dup_pairs(spark, sf):
    rows = images(spark, sf)
    found = greedy.suppress(rows.select("id", "seq"), [I.image_tier(rows)])
    return _shown(found).withColumn("score", F.round("score", 4))


# Every 25th image and its brighter copy are twice as large: each pixel four times. Pairs are compared at the size of the later one.
_SSIM_SIZES = f"""im AS MATERIALIZED (SELECT id, gray, (id // 2) % 25 = 0 AS big FROM {IMAGES}),
sized AS MATERIALIZED (SELECT id, 8 AS side, gray FROM im UNION ALL
  SELECT id, 16, list_transform(range(256), lambda k: gray[CAST(1 + (k // 32) * 8 + (k % 16) // 2 AS BIGINT)]) FROM im),
corner AS (SELECT 8 AS side, unnest([0, 1, 8, 9]) AS c UNION ALL SELECT 16, r * 16 + k FROM range(10) a(r), range(10) b(k)),
win AS MATERIALIZED (SELECT id, side, c, m, list_transform(px, lambda p: p - m) AS d FROM (SELECT id, side, c, px, list_avg(px) AS m FROM (
  SELECT id, sized.side, c, list_transform(range(49), lambda k: gray[CAST(1 + c + (k // 7) * sized.side + k % 7 AS BIGINT)]) AS px
  FROM sized JOIN corner USING (side)))),
wv AS MATERIALIZED (SELECT *, list_dot_product(d, d) / 48 AS var FROM win),
sim AS MATERIALIZED (SELECT a.id, b.id AS other_id, avg((2 * a.m * b.m + 6.5025) / (a.m * a.m + b.m * b.m + 6.5025)
  * (2 * list_dot_product(a.d, b.d) / 48 + 58.5225) / (a.var + b.var + 58.5225)) AS score
  FROM wv a JOIN im ON im.id = a.id AND a.side = CASE WHEN big THEN 16 ELSE 8 END JOIN wv b ON a.c = b.c AND a.side = b.side AND b.id < a.id GROUP BY ALL)"""


@_register("image_dup_sizes", f"""WITH RECURSIVE {_SSIM_SIZES}, edges AS MATERIALIZED (
  SELECT id, other_id, score, 'image' AS tier, 0 AS rank FROM sim WHERE round_even(score, 2) > 0.9), {_GREEDY}
SELECT id, tier, matched_id, round(score, 4) AS score FROM why""")
def image_dup_sizes(spark, sf):
    """Images of two sizes, compared at full size."""
    rows = images(spark, sf)
    big = F.floor(F.col("id") / 2) % 25 == 0
    doubled = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.get("gray", (F.floor(k / 32) * 8 + F.floor((k % 16) / 2)).cast("int")))
    side = F.when(big, 16).otherwise(8)
    rows = rows.withColumns({"gray": F.when(big, doubled).otherwise(F.col("gray")), "height": side, "width": side})
    found = greedy.suppress(rows.select("id", "seq"), [I.image_tier(rows)])
    return _shown(found).withColumn("score", F.round("score", 4))


@_register("image_hist_corr", f"""
WITH px AS (SELECT id, unnest(gray) AS bin FROM {IMAGES}), h AS (SELECT id, bin, count(*) AS n FROM px WHERE bin < 255 GROUP BY ALL),
s AS (SELECT id, sum(n) AS s, sum(n * n) AS q FROM h GROUP BY 1),
ab AS (SELECT a.id, sum(a.n * b.n) AS x FROM h a JOIN h b ON b.id = a.id - 1 AND a.bin = b.bin WHERE a.id % 2 = 1 GROUP BY 1)
SELECT a.id, round((coalesce(x, 0) - a.s * b.s / 256.0) / sqrt((a.q - a.s * a.s / 256.0) * (b.q - b.s * b.s / 256.0)), 6) AS corr
FROM s a JOIN s b ON b.id = a.id - 1 LEFT JOIN ab ON ab.id = a.id WHERE a.id % 2 = 1""")
def image_hist_corr(spark, sf):
    bins = I.histogram_bins(images(spark, sf))
    # The brighter copy follows its original: pair number 2i + 1 with 2i.
    pairs = images(spark, sf).where("id % 2 = 1").select("id", (F.col("id") - 1).alias("other_id"))
    return I.histogram_correlation(pairs, bins).select("id", F.round("corr", 6).alias("corr"))


# --- cascade -------------------------------------------------------------------------------------------

_BOTH = """edges AS MATERIALIZED (SELECT id, other_id, 1.0::DOUBLE AS score, 'stem' AS tier, 0 AS rank FROM runs
  UNION ALL SELECT id, other_id, score, 'words', 1 FROM overlap WHERE (score > 0.7 OR same) AND len >= 10"""


@_register("greedy_dedup", f"""WITH RECURSIVE {_stem_sql(_DOCS_TEXT)}, {_word_sql(_DOCS_TEXT)}, {_BOTH}), {_GREEDY}
SELECT id, tier, matched_id, score FROM why""")
def greedy_dedup(spark, sf):
    rows = texts(spark, sf)
    tiers = [stems.stem_tier(rows), words.overlap_tier(rows, min_later=10)]
    return _shown(greedy.suppress(stems.keyed_rows(rows), tiers))


HORIZON = 150


@_register("greedy_dedup_horizon", f"""WITH RECURSIVE {_stem_sql(_DOCS_TEXT)}, {_word_sql(_DOCS_TEXT)}, {_BOTH.replace("edges AS", "every AS")}),
arrival AS MATERIALIZED (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
edges AS MATERIALIZED (SELECT e.* FROM every e JOIN arrival a ON a.id = e.id JOIN arrival b ON b.id = e.other_id
  WHERE a.n - b.n <= {HORIZON}), {_GREEDY}
SELECT id, tier, matched_id, score FROM why""")
def greedy_dedup_horizon(spark, sf):
    """Duplicates of what was kept among the last messages."""
    rows = settle(horizon.arrivals(texts(spark, sf).select("id", "seq", "text")))
    tiers = [stems.stem_tier(rows), words.overlap_tier(rows, min_later=10)]
    return _shown(horizon.suppress_within(rows, tiers, HORIZON))


_ARRIVAL = "arrival AS MATERIALIZED (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS n FROM documents)"
_NEAR = f"JOIN arrival a ON a.id = e.id JOIN arrival b ON b.id = e.other_id WHERE a.n - b.n <= {HORIZON}"


@_register("word_overlap_top3_horizon", f"""WITH RECURSIVE {_word_sql(_DOCS_TEXT)}, {_ARRIVAL},
edges AS MATERIALIZED (SELECT e.* FROM ({_WORD_EDGES}) e {_NEAR}), {_GREEDY},
ranked AS (SELECT e.id, e.other_id, round(score, 6) AS score, row_number() OVER (PARTITION BY e.id ORDER BY score DESC, e.other_id) AS rank
  FROM overlap e {_NEAR} AND e.other_id NOT IN (SELECT id FROM lost))
SELECT id, CAST(rank AS INTEGER) AS rank, other_id, score FROM ranked WHERE rank <= 3""")
def word_overlap_top3_horizon(spark, sf):
    """The three best matches of every message among the kept ones of the last messages, however low they score."""
    rows = settle(horizon.arrivals(texts(spark, sf).select("id", "seq", "text")))
    decisions = horizon.suppress_within(rows, [words.overlap_tier(rows)], HORIZON)
    sets = words.hashed_sets(rows).where("n > 0")
    return horizon.best_within(sets, decisions.where("kept"), HORIZON, 3, horizon.word_scores(), "words").withColumn("score", F.round("score", 6))


@_register("embedding_top1_horizon", f"""
WITH v AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings)
SELECT id, other_id, round(score, 6) AS score FROM (SELECT a.id, b.id AS other_id, list_dot_product(a.e, b.e) AS score,
  row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.e, b.e) DESC, b.id) AS r
  FROM v a JOIN v b ON b.n < a.n AND a.n - b.n <= {HORIZON} WHERE list_dot_product(a.e, b.e) > 0) WHERE r = 1""")
def embedding_top1_horizon(spark, sf):
    """The most similar of the last messages, however little similar it is."""
    vecs = spread_small(table(spark, sf, "embeddings")).select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vec"))
    rows = settle(horizon.arrivals(vecs))
    found = horizon.best_within(rows, rows, HORIZON, 1, horizon.vector_scores, "vec")
    return found.select("id", "other_id", F.round("score", 6).alias("score"))


def curated_messages(spark, sf):
    """The signed documents with links; German ones are forwards."""
    rows = signed(spark, sf).join(
        table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url"), "id", "left"
    ).withColumn("text", F.concat("text", F.lit(" "), F.coalesce("url", F.lit("")))).drop("url")
    return rows.withColumn("is_forward", F.col("lang") == "de")


def curated_lists(spark, sf):
    """The blocklist. The signature stands in front of every text, so it does in front of the blocklisted ones."""
    toxic = signed(spark, sf).join(table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return Dims(blocklist=toxic.select(F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" ")).alias("text")))


def curated(spark, sf):
    """The whole curation of the signed documents, with vectors and blocklist."""
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), F.col("embedding").alias("vec"))
    dims = replace(curated_lists(spark, sf), vectors=vecs)
    return run_curate(curated_messages(spark, sf).drop("id"), dims, Options(embedding_threshold=VECTOR_THRESHOLD, max_latest_messages=0)).withColumn("id", F.col("seq"))


_CURATED_SRC = f"""(SELECT d.id, d.seq, d.chat_id, d.chat_title, d.lang, d.text || ' ' || coalesce(p.url, '') AS text FROM (
  SELECT doc_id AS id, doc_id AS seq, CAST(substr(source, 4) AS BIGINT) AS chat_id, source AS chat_title, lang,
    source || ' news: ' || text AS text FROM documents) d LEFT JOIN pages p ON p.page_id = d.id)"""
_BLOCKED = """(SELECT source || ' news: ' || replace(text, chr(10), ' ') || ' ' FROM documents WHERE doc_id IN (
  SELECT doc_id FROM labels WHERE toxic = 1))"""
_STRIP_CURATED = _STRIP.replace(_STRIP[_STRIP.index("FROM (SELECT id, seq"):_STRIP.index("),\nstep AS")], "FROM passing", 1).replace(
    "RECURSIVE src", "src", 1)
_CURATE = f"""WITH RECURSIVE al AS MATERIALIZED (SELECT *, replace(text, chr(10), ' ') IN {_BLOCKED} AS ad FROM {_CURATED_SRC}),
passing AS MATERIALIZED (SELECT * FROM al WHERE NOT ad), {_STRIP_CURATED},
clean AS MATERIALIZED (SELECT seq AS id, regexp_replace(clean, 'https?://[^ \\t\\n\\r\\f\\v]+', '', 'g') AS text FROM step WHERE n > 0),
{_stem_sql('clean')}, {_word_sql('clean')},
v AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, length(text) AS len FROM embeddings
  JOIN clean ON clean.id = vec_id WHERE length(text) > 0),
dots AS MATERIALIZED (SELECT * FROM (SELECT a.id, b.id AS other_id, list_dot_product(a.e, b.e) AS score
  FROM v a JOIN v b ON b.id < a.id WHERE a.len >= 10) WHERE score > {VECTOR_THRESHOLD}),
{_BOTH} UNION ALL SELECT id, other_id, score, 'embedding', 2 FROM dots), {_GREEDY},
result AS (SELECT al.id, al.chat_id, CASE WHEN ad THEN 'ad' WHEN why.id IS NOT NULL THEN 'duplicate' ELSE 'sent' END AS outcome,
  why.tier, why.matched_id, why.score, CASE WHEN al.lang = 'de' THEN 'control' END AS target_channel,
  md5(coalesce(clean.text, al.text)) AS digest FROM al LEFT JOIN clean ON clean.id = al.id LEFT JOIN why ON why.id = al.id)"""


@_register("curate", f"{_CURATE} SELECT id, outcome, tier, matched_id, score, target_channel, digest FROM result")
def curate(spark, sf):
    return curated(spark, sf).select("id", "outcome", "tier", "matched_id", F.round("score", 6).alias("score"),
                                     "target_channel", F.md5("text").alias("digest"))


@_register("outcome_stats", f"{_CURATE} SELECT outcome, count(*) AS n FROM result GROUP BY 1")
def outcome_stats(spark, sf):
    return count_outcomes(curated(spark, sf))
