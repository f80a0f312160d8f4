"""Secrets in text: fixed formats, and random strings told apart by two character Markov models.

One model is trained on random strings, the other on ordinary identifiers and words. For a run of token characters
the difference of their log-likelihoods is summed character by character; the best stretch of a run is a secret when
its sum beats what held-out ordinary tokens reach, and so on with what is left of the run. The labelled sample holds the values found by the fixed formats and
generated random strings on one side, tokens of the same documents on the other.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The formats that are always reported.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
# The longest run a fixed format or a random string can stand in, and where assignments begin.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
NAMES = ("passw", "secret", "token", "api")
# Tokens that count as ordinary in the sample: letters only, as a secret that no format knows may hold digits.
ORDINARY = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z][A-Za-z_-]{2,39}(?![A-Za-z0-9_-])")
# The documented bounds of the training sample: rows of documents, tokens of each label.
SAMPLE_ROWS, SAMPLE_TOKENS = 2000, 20_000
# Words of which names in code are made.
COMMON = """
abstract account address agent api array async base batch block body buffer build bundle byte cache call change channel check class client cluster
code color column command commit config connect context control count create current data date debug default delete device document domain
engine entity error event example factory field file filter format frame function get graph group handler header history host http image index
input insert instance interface item java job json key label layer length level library limit link list loader lock manager map member memory
message method model module monitor name network node number object offset option order package page parameter parse path plugin pool
profile property proxy public python query queue range read record request resource response result role root route run schema script search
server service session set single singleton size source stack state status storage string switch system table task template test thread time
transaction type update url user value version video view web window worker write xml
schiff fahrt gesellschaft haus werk versicherung verkehr ordnung donau dampf zeit
""".split()
# Ordinary, though its digits are random.
UUID = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])")
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
INDEX = {c: i for i, c in enumerate(LETTERS)}
SHORTEST = 16


def fixed(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed formats, leftmost and without overlaps within a kind."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    for run in RUN.finditer(text):
        a, s = run.start(), run.group()
        if "AKIA" in s:
            out += [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(s) if m.end() - m.start() >= 18]
        out += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(s) if m.end() - m.start() >= 16]
    return sorted(out)


@dataclass
class Model:
    """``gain[i, j]``: log-likelihood ratio of character j after i; ``bar``: the sum a secret must beat."""

    gain: np.ndarray
    bar: float

    def best(self, s: str) -> tuple[float, int, int]:
        """The stretch of at least 16 characters with the largest sum, and that sum."""
        gain, start = self.gain, len(LETTERS)
        # Sums up to each character; inside a run the first character of a stretch costs what it costs at a start.
        total, sums = 0.0, [0.0]
        first = [gain[start, INDEX[c]] for c in s]
        prev = None
        for c in s:
            j = INDEX[c]
            total += 0.0 if prev is None else gain[prev, j]
            sums.append(total)
            prev = j
        found, low, low_at = (-np.inf, 0, 0), -np.inf, 0
        for end in range(SHORTEST, len(s) + 1):
            at = end - SHORTEST
            if first[at] - sums[at + 1] > low:
                low, low_at = first[at] - sums[at + 1], at
            if sums[end] + low > found[0]:
                found = (sums[end] + low, low_at, end)
        return found


def _counts(strings: list[str]) -> np.ndarray:
    counts = np.full((len(LETTERS) + 1, len(LETTERS)), 0.5)
    for s in strings:
        prev = len(LETTERS)
        for c in s:
            j = INDEX[c]
            counts[prev, j] += 1
            prev = j
    return np.log(counts / counts.sum(1, keepdims=True))


def random_strings(n: int, seed: int = 1) -> list[str]:
    """Labelled random strings of the usual alphabets."""
    r = random.Random(seed)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", LETTERS[:62], LETTERS[:64], LETTERS[26:62], LETTERS[:26] + LETTERS[52:62]]
    return ["".join(r.choice(alphabets[i % len(alphabets)]) for _ in range(r.randint(20, 44))) for i in range(n)]


def identifiers(words: list[str], seed: int = 2) -> list[str]:
    """Ordinary strings: the words themselves, words joined the ways names and paths join them, versions, dates and rulers."""
    r = random.Random(seed)
    joined = []
    for i in range(max(len(words), 4000)):
        parts = [r.choice(words if r.random() < 0.5 else COMMON) for _ in range(r.randint(2, 5))]
        low, day = [p.lower() for p in parts], f"{r.randint(1990, 2030)}{r.randint(1, 12):02}{r.randint(1, 28):02}"
        joined.append([
            "_".join(parts), "-".join(parts), "/".join(parts), "".join(p.capitalize() for p in parts), "_".join(parts).upper(),
            f"{'-'.join(parts)}-{r.randint(0, 2030)}", low[0] + "".join(p.capitalize() for p in low[1:]), "".join(low),
            "/" + "/".join(low[:-1]) + f"/{low[-1]}{r.randint(0, 9)}-{r.choice(low)}", f"{r.randint(0, 30)}-{low[0][:3]}{r.randint(0, 9)}+{low[1]}{day}",
            f"{low[0]}/{day[:4]}/{day[4:6]}/{day[6:]}/{'-'.join(low[1:])}-{r.randint(1, 99999)}", f"{day[:4]}-{day[4:6]}-{day[6:]}T{r.randint(0, 23):02}-{r.randint(0, 59):02}-00",
            r.choice("-_=+/") * r.randint(16, 90), "".join(p.upper() if len(p) < 5 else p.capitalize() for p in parts),
        ][i % 14])
    return words + COMMON + joined


def train(secrets: list[str], words: list[str]) -> Model:
    """Two first-order models, and the bar at the best sum that one in 2,000 held-out ordinary strings reaches."""
    clean = lambda xs: ["".join(c for c in x if c in INDEX) for x in xs]
    random_side = clean(secrets) + random_strings(3000)
    plain = identifiers(sorted(x for x in clean(words) if x) or ["word"])
    model = Model(_counts(random_side) - _counts([x for i, x in enumerate(plain) if i % 5]), 0.0)
    sums = [model.best(x)[0] for x in plain[::5] if len(x) >= SHORTEST]
    # A string that both models explain alike is no secret.
    model.bar = max(0.0, float(np.quantile(sums, 0.9995))) if sums else 0.0
    return model


def quality(model: Model, secrets: list[str], ordinary: list[str]) -> tuple[float, float]:
    """Precision and recall on labelled strings that the training has not seen."""
    hit = lambda xs: sum(bool(find(x, model)) for x in xs)
    good, bad = hit(secrets), hit(ordinary)
    return good / max(1, good + bad), good / max(1, len(secrets))


def labelled_sample(docs: DataFrame, text: str = "text", id: str = "doc_id", rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str]]:
    """Values of fixed formats, and other tokens, of ``rows`` documents chosen by a hash of their id."""
    order = F.xxhash64(F.col(id))
    bar = docs.select(order.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if bar is None:
        return [], []
    chosen = docs.where(order <= bar).select(F.col(text).alias("t")).limit(rows)

    @F.arrow_udf("array<struct<secret:boolean,token:string>>")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("secret", pa.bool_()), ("token", pa.string())]))
        for batch in batches:
            rows = []
            for t in batch.to_pylist():
                found = set()
                for start, k, end in fixed(t or ""):
                    value = ASSIGN.match(t, start, end).group(1) if k == 0 else t[start:end]
                    found.add((True, value))
                values = {v for _, v in found}
                found |= {(False, w) for w in set(ORDINARY.findall(t or "")) if not any(w in v for v in values)}
                rows.append([{"secret": s, "token": v} for s, v in found])
            yield pa.array(rows, kind)

    got = chosen.select(F.explode(tokens("t")).alias("x")).select("x.secret", "x.token").distinct()
    sides = []
    for side in (True, False):
        top = got.where(F.col("secret") == side).select("token").orderBy(F.xxhash64("token"), "token").limit(SAMPLE_TOKENS)
        sides.append([r.token for r in top.collect()])
    return sides[0], sides[1]


def parts(a: int, b: int, taken: list[tuple[int, int]], k: int) -> Iterator[tuple[int, int]]:
    """What the taken stretches, apart and in order from the k-th, leave of a stretch."""
    while k < len(taken) and taken[k][0] < b:
        yield a, max(a, taken[k][0])
        a = max(a, taken[k][1])
        k += 1
    yield a, b


def find(text: str, model: Model | None) -> list[tuple[int, int, int]]:
    """All spans: the fixed ones, and all random stretches of what these leave of the runs.

    After a hit the search goes on left and right of it, until no stretch beats the bar.
    """
    out = fixed(text)
    if model is None:
        return out
    taken: list[tuple[int, int]] = []
    # A UUID is cut out like a fixed span, and not reported.
    for s, e in sorted([(s, e) for s, _, e in out] + [m.span() for m in UUID.finditer(text)]):
        if taken and s < taken[-1][1]:
            taken[-1] = taken[-1][0], max(taken[-1][1], e)
        else:
            taken.append((s, e))
    extra, k = [], 0
    for run in RUN.finditer(text):
        while k < len(taken) and taken[k][1] <= run.start():
            k += 1
        left = list(parts(*run.span(), taken, k))
        while left:
            a, b = left.pop()
            if b - a < SHORTEST:
                continue
            total, start, end = model.best(text[a:b])
            if total > model.bar:
                extra.append((a + start, 3, a + end))
                left += [(a, a + start), (a + end, b)]
    return sorted(out + extra)


def scan(docs: DataFrame, model: Model | None, text: str = "text", into: str = "secrets") -> DataFrame:
    """Add ``into``: kind, start and end (code points, end exclusive) of every secret of the whole text, by start.

    A null or empty text has none. Other columns pass through; a column named ``into`` is replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            yield pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t, shipped.value)] if t else []
                            for t in batch.to_pylist()], kind)

    return docs.withColumn(into, spans(F.col(text)))


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``documents``: counts by fixed format, their digest, and all spans."""
    model = train(*labelled_sample(docs))
    found = scan(docs.select("doc_id", "text"), model).drop("text")
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", name), ",").alias("spans"), count("markov").alias("n_markov"),
    )
