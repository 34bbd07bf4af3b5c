"""Quality rules on DataFrame functions alone: document rules, then host verdicts from shrunken failure rates.

Each document's rules are computed in one pass and written once as a narrow table.
Failures are counted by host with map-side partial sums, each host's rate is shrunk by
an empirical beta prior fitted to all hosts, and verdicts are joined back to the
documents on the host; a hot host's documents are split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import number_of, numbered, saved, without

SPACE = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _repeat_words(words: Column, window: int) -> Column:
    """Words inside windows that occur twice or more; windows are compared by a 64-bit hash within one text."""

    def covered(keys: Column) -> Column:
        def marked(ordered: Column) -> Column:
            key = lambda i: F.get(ordered, i)["key"]  # noqa: E731  null outside
            again = F.filter(ordered, lambda x, i: F.coalesce(key(i - 1) == x["key"], F.lit(False)) | F.coalesce(key(i + 1) == x["key"], F.lit(False)))
            return _let(
                F.array_sort(F.transform(again, lambda x: x["at"])),
                lambda at: F.aggregate(
                    F.transform(at, lambda x, i: F.least(F.lit(window), F.coalesce(x - F.get(at, i - 1), F.lit(window)))), F.lit(0), lambda a, x: a + x
                ),
            )

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(
            _let(F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("at")))), marked)
        )

    keys = F.transform(F.sequence(F.lit(1), F.size(words) - F.lit(window - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(window))))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(_let(keys, covered))


RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def document_rules(docs: DataFrame, text: str = "text", window: int = 8, keep_text: bool = False) -> DataFrame:
    """The documents' other columns (with `keep_text` the text too) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    A null text has no words and fails; repeated rows are judged each for itself; an empty table gives an empty one.
    Columns of the documents with the names of the added ones give way to these.
    """
    others = without([c for c in docs.columns if keep_text or c != text], RULES)
    rows, of = numbered(docs), lambda c: F.col(number_of(docs, c))
    whole = F.coalesce(of(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    found = rows.select(
        *(number_of(docs, c) for c in others),
        F.array_remove(F.split(whole, SPACE), "").alias("words"),
        F.length(F.regexp_replace(whole, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(whole, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    ruled = found.select(
        *(of(c).alias(c) for c in others), F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", _repeat_words(F.col("words"), window).cast("long").alias("n_repeat_words")
    )
    return ruled.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def host_verdicts(judged: DataFrame, host: str = "source", failed: str = "base_failed", most: float = 0.5) -> DataFrame:
    """One row per host: n, n_failed, shrunk_rate and host_rejected; none for an empty table.

    The beta prior has the mean and variance of the hosts' own rates (method of moments,
    strength 1 to 1,000,000); a host is rejected where its shrunken rate exceeds `most`.
    A null host counts as one host of its own that is never rejected.
    """
    hosts = saved(judged.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("n_failed")), "hosts")
    rate = F.col("n_failed") / F.col("n")
    mean, spread = hosts.agg(F.avg(rate), F.var_pop(rate)).first()  # two numbers
    mean, spread = mean or 0.0, spread or 0.0
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select("_host", "n", "n_failed", shrunk.alias("shrunk_rate"), (F.col("_host").isNotNull() & (shrunk > most)).alias("host_rejected"))


def quality_verdicts(docs: DataFrame, text: str = "text", host: str = "source", most: float = 0.5) -> DataFrame:
    """The rules of each document and kept: false if its own rules fail or its host is rejected.

    As in document_rules, columns with the names of the added ones give way; a host column of such a name still counts as it was.
    """
    rows, of = numbered(docs), number_of(docs, host)
    judged = saved(document_rules(rows, number_of(docs, text)), "rules")
    rejected = host_verdicts(judged, of, most=most).where("host_rejected").select("_host")
    joined = judged.join(rejected, F.col(of) == F.col("_host"), "left")
    others = without([c for c in docs.columns if c != text], [*RULES, "kept"])
    kept = ~F.col("base_failed") & F.col("_host").isNull()
    return joined.select(*(F.col(number_of(docs, c)).alias(c) for c in others), *RULES, kept.alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", most: float = 0.5) -> DataFrame:
    """The documents that pass: their own rules hold and their host isn't rejected. Columns stay.

    The judged documents are written once, so that the rules are computed once for verdicts and filter.
    """
    rows, of = numbered(docs), number_of(docs, host)
    judged = saved(document_rules(rows, number_of(docs, text), keep_text=True).select(*rows.columns, "base_failed"), "judged")
    rejected = host_verdicts(judged, of, most=most).where("host_rejected").select("_host")
    return judged.where(~F.col("base_failed")).join(rejected, F.col(of) == F.col("_host"), "left_anti").select(*rows.columns).toDF(*docs.columns)
