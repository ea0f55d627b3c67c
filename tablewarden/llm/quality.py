"""Document quality rules and host verdicts, in DataFrame expressions only.

Every count is taken inside the row (no word leaves its document). Rule failures are summed by host, the
hosts' rates are shrunk with a beta prior fitted to all hosts, and a host whose shrunk rate is too high
takes its documents along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import looked_up, stored

_BLANK = r"[\x20\x09-\x0D]+"
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"
WINDOW = 5


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: an expression used inside a lambda would be computed
    again for every element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def _stripped(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeated_words(w: Column, n: int = WINDOW) -> Column:
    """Words that lie in an ``n``-word window which occurs at least twice."""
    last = F.size(w) - n
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(w[i + j] for j in range(n))))
    windows = F.array_sort(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.array_join(F.slice(w, i + 1, F.lit(n)), " ").alias("w"), i.alias("i"))))
    # equal windows are neighbours now; both of a pair of neighbours are hit
    pairs = lambda s: F.flatten(F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    starts = let(windows, lambda s: F.array_sort(F.array_distinct(pairs(s))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + i + n - F.greatest(i, a["end"])).alias("n"), (i + n).alias("end")), lambda a: a["n"])
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when((last > 0) & some, covered).otherwise(F.lit(0))


def base_counts(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = let(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")),
    )
    row = documents.select(
        *keep,
        counts.alias("__c"),
        (F.length(F.translate(text, _BLANKS, ""))).cast("long").alias("word_chars"),
        _stripped(text, _SYMBOLS).cast("long").alias("n_symbols"),
        duplicate_lines(text).cast("long").alias("n_dup_lines"),
    )
    return row.select(*keep, "__c.n_words", "word_chars", "n_symbols", "n_dup_lines", "__c.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_failed() -> Column:
    """Base rules, and: symbols in more than a tenth of the words, or a mean word outside 2 to 15 characters."""
    return base_failed() | (10 * F.col("n_symbols") > F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))


def host_verdicts(counts: DataFrame, most: float = 0.5) -> DataFrame:
    """``host, rate, host_kept``: each host's failure rate, shrunk towards all hosts' by a beta prior.

    The prior's two parameters are fitted to the hosts' rates by moments, less the variance that chance alone
    gives hosts of their sizes. A host is rejected if its shrunk rate lies three of the prior's standard
    deviations above its mean and is twice the mean, or is above ``most``.
    """
    hosts = counts.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(rule_failed().cast("long")).alias("bad"))
    rate = F.col("bad") / F.col("n")
    m = hosts.agg(F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"), F.avg(1 / F.col("n")).alias("chance")).first()  # one row
    mean = min(max(m["mean"] if m["mean"] is not None else 0.5, 0.001), 0.999)
    spread = (m["var"] or 0.0) - mean * (1 - mean) * (m["chance"] or 0.0)
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1000.0) if spread > 0 else 1000.0
    cut = round(min(max(mean + 3 * math.sqrt(mean * (1 - mean) / (strength + 1)), 2 * mean), most), 6)
    shrunk = F.round((F.col("bad") + mean * strength) / (F.col("n") + strength), 9)
    return hosts.select("host", shrunk.alias("rate"), (shrunk <= cut).alias("host_kept"))


def judge_documents(documents: DataFrame, host: str = "source", most: float = 0.5) -> DataFrame:
    """Counts and verdict of every document.

    Returns ``doc_id``, the five counts, ``base_failed``, ``kept`` and ``host_rate``. Words stand between
    white space (0x20, 0x09 to 0x0D). ``kept`` is false if a base rule fails or if the host is rejected (see
    ``host_verdicts``); a document without a host goes by its own rules. A null or empty text has no words
    and fails. Repeated rows stay, an empty table gives an empty result, other columns play no part.
    """
    rows = documents.select("doc_id", F.col(host).cast("string").alias("host"), "text")
    counts = stored(base_counts(rows, ["doc_id", "host"]), "quality-counts")
    # written first: its known size lets it go to the documents, and not the documents to it
    verdicts = stored(host_verdicts(counts, most), "quality-hosts")
    failed = base_failed()
    return looked_up(counts, verdicts, ["host"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce("host_kept", F.lit(True))).alias("kept"), F.col("rate").alias("host_rate")
    )
