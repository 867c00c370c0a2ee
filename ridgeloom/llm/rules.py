"""Host-level quality rules: failures by host, shrunk by an empirical beta prior, joined back to documents.

One pass over the texts measures each document; the measures (a few numbers a row) are written once. A partial
aggregation then leaves one row per task and host, so a host with a third of all rows costs no more than any
other, and the host verdicts are joined back to the measures, not to the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeloom.llm.shared import dense, map_texts, slices, staged, texts_of, windows, word_codes

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\v\f\r"

#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Further rules, which count towards a host's failures only.
MAX_SYMBOLS_PER_WORD, MAX_DUP_LINES_PER_WORD, MIN_WORD_CHARS, MAX_WORD_CHARS = 0.1, 0.02, 2.0, 14.0
#: A host goes when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5

MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source"), text_col: str = "text") -> DataFrame:
    """The five counts of each whole text, beside the columns in ``keep``. A null text counts as empty."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = texts_of(batch, text_col)
            rows = len(texts)
            codes, owner, _ = word_codes(texts)
            n_words = np.bincount(owner, minlength=rows)
            number, place = windows(codes, owner, 3)
            in_text, count = dense(owner[place] * (number.max(initial=0) + 1) + number)
            again = np.zeros(len(codes) + 2, bool)
            twice = place[count[in_text] > 1] if len(place) else place
            for k in range(3):
                again[twice + k] = True
            n_repeat = np.bincount(owner, again[: len(codes)], rows)
            chars, symbols, dups = [], [], []
            for t in texts:
                chars.append(len(t) - sum(map(t.count, BLANK)))
                symbols.append(sum(map(t.count, SYMBOLS)))
                lines = Counter(t.split("\n"))
                dups.append(sum(c - 1 for line, c in lines.items() if c > 1 and line.strip(BLANK)))
            found = (n_words, chars, symbols, dups, n_repeat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(np.asarray(x, np.int64), pa.int64()) for x in found],
                [*keep, *(m.split()[0] for m in MEASURES.split(", "))],
            )

    return map_texts(docs.select(*keep, text_col), work, f"{kinds}, {MEASURES}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_failed() -> Column:
    """Base rules, many symbols, repeated lines or odd word lengths."""
    n = F.col("n_words")
    return (
        base_failed()
        | (F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * n)
        | (F.col("n_dup_lines") > MAX_DUP_LINES_PER_WORD * n)
        | (F.col("word_chars") < MIN_WORD_CHARS * n)
        | (F.col("word_chars") > MAX_WORD_CHARS * n)
    )


def host_rates(measures: DataFrame, host_col: str) -> DataFrame:
    """host, n, failed and rate: the posterior mean under a beta prior fitted to all hosts by moments.

    With overall rate m, the between-host variance is the weighted variance of the rates less what binomial
    sampling explains; the prior's strength is m(1-m)/variance - 1, held within 1 and a million.
    """
    hosts = measures.groupBy(host_col).agg(F.count("*").alias("n"), F.sum(rule_failed().cast("long")).alias("failed"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count("*").alias("hosts"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("square")).first()
    n = total.n or 1
    m = (total.failed or 0) / n
    spread = m * (1 - m)
    between = (total.square or 0.0) / n - m * m - spread * (total.hosts or 0) / n
    strength = min(max(spread / between - 1, 1.0), 1e6) if between > 1e-12 else 1e6
    return hosts.withColumn("rate", (F.col("failed") + m * strength) / (F.col("n") + strength))


def host_rules(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdict for each row: id, the five measures, base_failed, host_rejected and kept.

    A document is kept unless it fails a base rule or its host's shrunk failure rate exceeds MAX_HOST_RATE.
    Rows without a host form one group of their own (null-safe). A null or empty text has no words and so fails
    the base rules. Repeated rows count and return as often as they occur; an empty table gives an empty one;
    extra columns are not read, so their names cannot clash.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    measures = staged(measure(plain, ("doc_id", "host")), "rules")
    rates = host_rates(measures, "host").select(F.col("host").alias("of"), (F.col("rate") > MAX_HOST_RATE).alias("host_rejected"))
    joined = measures.join(rates, F.col("host").eqNullSafe(F.col("of")), "left")
    failed = base_failed()
    return joined.select(
        F.col("doc_id").alias(id_col),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.coalesce("host_rejected", F.lit(False)).alias("host_rejected"),
        (~failed & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
tri AS (
  SELECT rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
ln AS (SELECT rid, l, count(*) - 1 AS extra FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid, l),
dup AS (SELECT rid, sum(extra)::BIGINT AS n FROM ln GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, source, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
g AS (
  SELECT *, base_failed OR n_symbols > 0.1 * n_words OR n_dup_lines > 0.02 * n_words
            OR word_chars < 2 * n_words OR word_chars > 14 * n_words AS failed FROM f),
h AS (SELECT source, count(*) AS n, sum(failed::INT)::DOUBLE AS bad FROM g GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS n, sum(bad) / sum(n) AS m, count(*) AS hosts, sum(bad * bad / n) AS square FROM h),
v AS (SELECT m, m * (1 - m) AS spread, square / n - m * m - m * (1 - m) * hosts / n AS between_hosts FROM t),
k AS (SELECT m, CASE WHEN between_hosts > 1e-12 THEN least(greatest(spread / between_hosts - 1, 1.0), 1e6) ELSE 1e6 END AS strength FROM v),
r AS (SELECT source, (bad + m * strength) / (n + strength) > 0.5 AS host_rejected FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected,
       NOT base_failed AND NOT host_rejected AS kept
FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source
"""
