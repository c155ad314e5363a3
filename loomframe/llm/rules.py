"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule names the measures that it needs, the condition under which it rejects a row, and the work that a row costs it. On a sample of
the rows each rule's mean work and share of rejected rows are estimated; rules then run in the order of rejections for the work, and
a rule's measures are computed only for rows that no earlier rule has rejected. The order depends on the rows alone, not on clocks or
partitions, and it changes the work and the name of the rejecting rule, never the verdict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm import common

Step = dict[str, Callable[[], Column]]
WINDOW = 8
#: Fewer repeated lines never reject a row: a short text may well end as it began.
LEAST_DUP_LINES = 3
#: Rows of the sample that the order is estimated on, about; a table of no more is its own sample.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """``steps``: columns to add, each step able to use those before it; ``reject``: true for a row to drop; ``work``: what the row
    costs, in words or as many characters as go for one."""

    name: str
    reject: Callable[[], Column]
    steps: tuple[Step, ...] = ()
    measures: tuple[str, ...] = ()
    work: Callable[[], Column] = lambda: F.lit(1).cast("long")


def _text() -> Column:
    return F.col("_text")


def _words() -> Column:
    return F.regexp_extract_all(_text(), F.lit(common.WORD), F.lit(0))


def _symbols() -> Column:
    return F.regexp_count(_text(), F.lit("[#*$%&|<>]"))


def _lines() -> Column:
    return F.filter(F.split(_text(), r"\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _paired(name: str, step: int) -> Column:
    """A hash of each entry with the one ``step`` places on: twice as many words as an entry stands for."""
    h = F.col(name)
    n = F.greatest(F.size(h) - step, F.lit(0))
    return F.slice(F.zip_with(h, F.slice(h, step + 1, n), lambda a, b: F.xxhash64(a, b)), 1, n)


def _if_repeated(name: str, step: int) -> Column:
    """Only where an entry occurs twice can a longer window do so."""
    return F.when(F.size(F.array_distinct(name)) < F.size(name), _paired(name, step))


def _sorted() -> Column:
    """Where a window occurs twice or more: (hash, position) of all windows in the order of hashes."""
    w = F.col("_windows")
    return F.when(F.size(F.array_distinct(w)) < F.size(w), F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))


def _places() -> Column:
    """Positions of repeated windows, in order."""
    s = F.col("_sorted")
    like = lambda x, k: F.coalesce(x.h == F.get(s, k).h, F.lit(False))
    return F.array_sort(F.filter(F.transform(s, lambda x, i: F.when(like(x, i - 1) | like(x, i + 1), x.i)), lambda p: p.isNotNull()))


def _repeated() -> Column:
    p = F.col("_places")
    step = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
    return F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0))




def _chars(per_word: int) -> Column:
    """The work of a pass over the text of which ``per_word`` bytes go for one word."""
    return F.floor(F.octet_length(_text()) / per_word).cast("long") + 1


#: Made for every row, as each rule needs them.
BASE: tuple[Step, ...] = ({"_words": _words}, {"n_words": lambda: F.size("_words").cast("long")})

RULES = (
    Rule("too_short", lambda: F.col("n_words") < 20, (), ("n_words",)),
    Rule(
        "repeats", lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        (
            {"_twos": lambda: F.when(F.col("n_words") > WINDOW, _paired("_words", 1))}, {"_fours": lambda: _if_repeated("_twos", 2)}, {"_windows": lambda: _if_repeated("_fours", 4)},
            {"_sorted": _sorted}, {"_places": _places}, {"n_repeat_words": lambda: _repeated().cast("long")},
        ),
        ("n_repeat_words",), lambda: F.col("n_words") + 1,
    ),
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words"), ({"n_symbols": lambda: _symbols().cast("long")},), ("n_symbols",), lambda: _chars(16)),
    Rule(
        "lines", lambda: (F.col("n_dup_lines") >= LEAST_DUP_LINES) & (100 * F.col("n_dup_lines") > 30 * F.col("_n_lines")),
        ({"_lines": _lines}, {"n_dup_lines": lambda: (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_n_lines": lambda: F.size("_lines")}),
        ("n_dup_lines",), lambda: _chars(8),
    ),
    Rule(
        "word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
        ({"word_chars": lambda: F.char_length(F.array_join("_words", "")).cast("long")},), ("word_chars",), lambda: _chars(32),
    ),
    Rule("shouting", lambda: 10 * F.col("_shouts") > 3 * F.col("n_words"), ({"_shouts": lambda: F.regexp_count(_text(), F.lit("[!?]"))},), work=lambda: _chars(16)),
)
#: The rules that the base verdict is made of.
BASE_RULES = ("too_short", "repeats")


def _with(rows: DataFrame, steps: tuple[Step, ...], open_: Column | None = None) -> DataFrame:
    for step in steps:
        rows = rows.withColumns({name: make() if open_ is None else F.when(open_, make()) for name, make in step.items()})
    return rows


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules in the order of rejections for the work, with the mean work and the share of rejected rows, estimated on about
    ``sample_rows`` rows of ``docs(doc_id, text)``.

    The sample serves this order alone: rows whose MD5 of doc_id and length comes before a bound, from all partitions. Ties keep
    the given order.
    """
    total = docs.count()
    bound = f"{min(1 << 32, (sample_rows << 32) // max(total, 1)):09x}"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = F.concat(F.lit("0"), F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.octet_length(text).cast("string"))), 1, 8))
    rows = _with(docs.select(place.alias("_place"), text.alias("_text")).where(F.col("_place") < bound).select("_text"), BASE)
    for rule in rules:
        rows = _with(rows, rule.steps)
    figures = [f(c).cast("long").alias(f"{name}{k}") for k, rule in enumerate(rules) for name, f, c in (("w", F.sum, rule.work()), ("n", F.count_if, F.coalesce(rule.reject(), F.lit(False))))]
    told = rows.agg(F.count("*").alias("of"), *figures).first()
    of = max(told["of"], 1)
    out = [(rule, (told[f"w{k}"] or 0) / of, told[f"n{k}"] / of) for k, rule in enumerate(rules)]
    return sorted(out, key=lambda x: -x[2] / max(x[1], 1e-9))


def cascade(docs: DataFrame, rules: list[Rule] | tuple[Rule, ...] = RULES, always: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with _text, the rules' measures and rejected_by: the first rule, in the given order, that rejects the row.

    A rule's measures are computed, and its condition tried, only where no earlier rule has rejected the row; elsewhere they are null.
    Rules named in ``always`` are measured on every row. The new columns leave through a generator, so filters on them stay above. A
    null text counts as empty. Columns of ``docs`` with the names of measures or with a leading underscore would clash: select before.
    """
    rows = _with(docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit(""))), BASE).withColumn("rejected_by", F.lit(None).cast("string"))
    for rule in rules:
        open_ = F.col("rejected_by").isNull()
        rows = _with(rows, rule.steps, None if rule.name in always else open_)
        rows = rows.withColumn("rejected_by", F.when(open_ & F.coalesce(rule.reject(), F.lit(False)), F.lit(rule.name)).otherwise(F.col("rejected_by")))
        rows = rows.drop(*(n for step in rule.steps for n in step if n.startswith("_")))
    made = [c for c in rows.columns if c not in (*docs.columns, "_words")]
    return rows.select(*docs.columns, common.held(F.struct(*made)).alias("_made")).select(*docs.columns, "_made.*")


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by), one row for each of ``docs``.

    rejected_by names the rule at which the cascade stopped, null for a row that is kept. The measures that are returned are made for
    every row, all else only up to the first rejection. Null and empty texts have no words and fail; repeated rows and null doc_ids
    each give their own row.
    """
    order = [r for r, _, _ in ordered(docs)]
    rows = cascade(docs.select("doc_id", "text"), order, always=tuple(r.name for r in RULES if r.measures))
    failed = F.lit(False)
    for rule in RULES:
        if rule.name in BASE_RULES:
            failed = failed | rule.reject()
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns kept; measures stop at the first rejection."""
    order = [r for r, _, _ in ordered(docs)]
    rows = cascade(docs.select(F.struct("*").alias("_row"), "text"), order)
    return rows.where("rejected_by is null").select("_row.*")


#: DuckDB SQL for ``judged``. Conditions and work stand as in RULES, in their order.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS shouts
  FROM d
),
windows AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS told FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
again AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, told) > 1),
steps AS (SELECT rid, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, {WINDOW})) AS n FROM again),
covered AS (SELECT rid, sum(n) AS n_repeat_words FROM steps GROUP BY rid),
m AS (
  SELECT rid, doc_id, t, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, shouts
  FROM w LEFT JOIN covered USING (rid)
),
judged AS (
  SELECT *, [n_words < 20, 100 * n_repeat_words > 30 * n_words, 10 * n_symbols > n_words, n_dup_lines >= {LEAST_DUP_LINES} AND 100 * n_dup_lines > 30 * n_lines,
    word_chars < 2 * n_words OR word_chars > 15 * n_words, 10 * shouts > 3 * n_words] AS rejects,
    [1, n_words + 1, (strlen(t) // 16) + 1, (strlen(t) // 8) + 1, (strlen(t) // 32) + 1, (strlen(t) // 16) + 1] AS work
  FROM m
),
sampled AS (
  SELECT rejects, work FROM judged
  WHERE '0' || substr(md5(concat_ws(':', doc_id, strlen(t))), 1, 8) < lpad(lower(to_hex(least(4294967296, {SAMPLE_ROWS} * 4294967296 // greatest((SELECT count(*) FROM documents), 1)))), 9, '0')
),
names AS (SELECT unnest(range(1, {len(RULES) + 1})) AS k, unnest([{", ".join(f"'{r.name}'" for r in RULES)}]) AS name),
figures AS (SELECT k, name, (sum(CAST(rejects[k] AS INT)) / greatest(count(rejects), 1)) / greatest(sum(work[k]) / greatest(count(rejects), 1), 1e-9) AS rate FROM names LEFT JOIN sampled ON true GROUP BY k, name),
placed AS (SELECT k, name, row_number() OVER (ORDER BY coalesce(rate, 0) DESC, k) AS place FROM figures),
first AS (SELECT rid, arg_min(name, place) AS rejected_by FROM judged, placed WHERE rejects[k] GROUP BY rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words,
  rejects[1] OR rejects[2] AS base_failed, rejected_by IS NULL AS kept, rejected_by
FROM judged LEFT JOIN first USING (rid)
"""
