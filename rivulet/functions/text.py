"""Text expressions. All are built-in Spark expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U): Java's \S is ASCII-only without it and would run over a no-break space.
LINK = r"(?U)https?://\S+"
WORD_SEPARATOR = r"[^\p{L}\p{N}]+"
# Letters, digits and the Hebrew alphabet only (fixed value).
WORD_SEPARATOR_HEBREW = "[^A-Za-z0-9אבגדהוזחטיכלמנסעפצקרךשתןףץם]+"


def strip_links(text: Column) -> Column:
    return F.regexp_replace(text, LINK, "")


def one_line(text: Column) -> Column:
    """Newlines become spaces, as blocklist lines are stored."""
    return F.replace(text, F.lit("\n"), F.lit(" "))


def word_set(text: Column, separator: str = WORD_SEPARATOR) -> Column:
    """Distinct words of a text; case matters."""
    return F.array_distinct(F.filter(F.split(text, separator), lambda w: w != ""))


def remove_all(text: Column, literals: Column) -> Column:
    """Delete every literal of the array from the text, in array order."""
    return F.aggregate(literals, text, lambda acc, s: F.replace(acc, s, F.lit("")))


def common_prefix_stem(first: Column, others: Column, min_len: int = 5) -> Column:
    """Longest prefix of ``first`` (at least ``min_len``) found anywhere in all ``others``; else ''.

    Being found is monotone in the prefix length, so the length is built up from
    powers of two instead of trying every one of them.
    """
    def found(n: Column) -> Column:
        return F.forall(others, lambda o: F.contains(o, F.left(first, n)))

    steps = F.array(*[F.lit(1 << p) for p in range(24, -1, -1)])
    longest = F.aggregate(
        steps,
        F.lit(min_len),
        lambda acc, step: F.when((acc + step <= F.length(first)) & found(acc + step), acc + step).otherwise(acc),
    )
    return F.when((F.length(first) >= min_len) & found(F.lit(min_len)), F.left(first, longest)).otherwise("")


def common_corner_stem(first: Column, others: Column, min_len: int = 5, corner_mode: str = "prefix") -> Column:
    """The longest prefix of ``first`` found in all ``others``; with ``both`` the longest suffix too, which wins ties."""
    prefix = common_prefix_stem(first, others, min_len)
    if corner_mode == "prefix":
        return prefix
    if corner_mode != "both":
        raise ValueError(f"unknown corner mode {corner_mode}")
    suffix = F.reverse(common_prefix_stem(F.reverse(first), F.transform(others, F.reverse), min_len))
    return F.when(F.length(prefix) > F.length(suffix), prefix).otherwise(suffix)


def stem_window(length: Column) -> Column:
    """Shortest run that is strictly longer than 0.8 of ``length``."""
    return F.floor(length * 4 / 5).cast("int") + 1


def has_common_run(text: Column, other: Column) -> Column:
    """True when ``other`` holds a run of ``text`` longer than 0.8 of it.

    Every such run covers the middle of the text, so the middle is looked up
    first; the sliding windows are only tried when it is there.
    """
    length = F.length(text)
    window = stem_window(length)
    middle = F.substring(text, length - window + 1, 2 * window - length)
    starts = F.sequence(F.lit(1), length - window + 1)
    return F.contains(other, middle) & F.exists(starts, lambda i: F.contains(other, F.substring(text, i, window)))
