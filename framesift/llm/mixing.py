"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic.  The token totals of the cells are raked:
scaled in turn so that their sums over each marginal meet that marginal's target, capped at what a
cell holds, until nothing changes any more.  A document then stays with the probability
raked tokens / tokens of its cell, drawn by a hash of the document.

Targets may be given per marginal; by default they are the corpus' own shares to the power ``temper``,
normed again, which lifts what is rare.  Everything is DataFrame code: the cell table is small next
to the corpus, because values of a marginal below a least share are joined into one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.session import cut_lineage

MARGINS = ("source", "lang", "topic")
#: Share of the corpus' tokens to keep, and the power that evens out shares.
KEEP, TEMPER = 0.6, 0.7
#: Least share of rows for a value of its own: so a marginal has at most 1 / LEAST + 1 values.
LEAST = 0.0001
#: Cycles at most, cycles in one job, and the change of any cell at which raking ends.
CYCLES, PER_JOB, TOLERANCE = 60, 4, 1e-9
OTHER, NONE = "(other)", "(none)"
#: Topics by the first rule that a text meets: name, pattern, and texts of which whatever the pattern matches
#: holds one, in lower case.  Patterns start with what is rare and take time in proportion to the text.
TOPICS = (
    ("licence", r"(?i)licen[cs]ed? under|released under the|copyright", ("under", "copyright")),
    ("credentials", r"(?i)(?:token|secret|password|api_?key)\s*[=:]\s*\S{8}", ("token", "secret", "password", "apikey", "api_key")),
    ("table", r"(?:\|[^|\n]{1,80}){4}", ("|",)),
    ("symbols", r"[%$&*#]{3}\s+\S*[%$&*#]{3}\s+\S*[%$&*#]{3}\s+", ()),
    ("contact", r"[\w.+-]@[\w-]+\.\w", ("@",)),
)


def topic_of(text: Column, rules: Sequence[tuple[str, str, Sequence[str]]] = TOPICS, rest: str = "prose") -> Column:
    """Name of the first rule whose pattern the text holds; a null or blank text is (none).

    A pattern runs only over texts that hold one of its needles, which is a plain byte search.
    """
    out = F.when(text.isNull() | ~text.rlike(r"\S"), F.lit(NONE))
    low = F.lower(text)
    for name, pattern, needles in rules:
        held = text.rlike(pattern)
        if needles:
            held = reduce(lambda a, b: a | b, [F.contains(low, F.lit(n)) for n in needles]) & held
        out = out.when(held, F.lit(name))
    return out.otherwise(F.lit(rest))


def _folded(rows: DataFrame, name: str, total: int) -> DataFrame:
    """Joins values with less than the least share of rows into one; a null is a value of its own."""
    counts = rows.groupBy(name).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= LEAST * total).select(F.col(name).alias("__v"))
    # At most 1 / LEAST values are left, so they may be broadcast.
    return rows.join(F.broadcast(counts), rows[name] == F.col("__v"), "left").withColumn(name, F.coalesce("__v", F.lit(OTHER))).drop("__v")


def rake(cells: DataFrame, margins: Sequence[str] = MARGINS, keep: float = KEEP, temper: float = TEMPER,
         targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """``cells`` (margins…, tokens) with ``raked``: tokens to keep of each cell, at most what it holds.

    ``targets`` gives shares per marginal and value; values without one, and marginals without an
    entry, get the tempered share.  Shares are normed to one and times ``keep`` of all tokens.
    """
    state = cells.withColumn("tokens", F.col("tokens").cast("double"))
    total = state.agg(F.coalesce(F.sum("tokens"), F.lit(0.0))).first()[0]
    for m in margins:
        over = Window.partitionBy(m)
        share = F.pow(F.sum("tokens").over(over) / F.lit(total), F.lit(temper)) if total else F.lit(0.0)
        for value, wanted in (targets or {}).get(m, {}).items():
            share = F.when(F.col(m) == value, F.lit(float(wanted))).otherwise(share) if total else share
        state = state.withColumn(f"__share_{m}", share).withColumn(f"__rows_{m}", F.count(F.lit(1)).over(over))
    # A value's share stands in each of its cells; the norm counts it once.
    norms = state.agg(*[F.sum(F.col(f"__share_{m}") / F.col(f"__rows_{m}")).alias(m) for m in margins]).first()
    wanted = {m: F.col(f"__share_{m}") / F.lit(float(norms[m] or 1.0)) * F.lit(keep * total) for m in margins}
    state = state.select(*margins, "tokens", *[wanted[m].alias(f"__target_{m}") for m in margins], (F.col("tokens") * keep).alias("raked"))
    state = cut_lineage(state, "raking")
    done = 0
    while done < CYCLES:
        now = state
        for _ in range(PER_JOB):
            now = now.withColumn("__before", F.col("raked"))
            for m in margins:
                held = F.sum("raked").over(Window.partitionBy(m))
                now = now.withColumn("raked", F.when(held > 0, F.col("raked") * F.col(f"__target_{m}") / held).otherwise(F.lit(0.0)))
            now = now.withColumn("raked", F.least("raked", "tokens"))
        state = cut_lineage(now, "raking")
        done += PER_JOB
        moved = state.agg(F.max(F.abs(F.col("raked") - F.col("__before")))).first()[0]
        state = state.drop("__before")
        if not moved or moved <= TOLERANCE * max(total, 1.0):
            break
    return state


def mixed(docs: DataFrame, keep: float = KEEP, temper: float = TEMPER, seed: int = 11,
          targets: Mapping[str, Mapping[str, float]] | None = None, topics: Sequence[tuple[str, str, Sequence[str]]] = TOPICS) -> tuple[DataFrame, DataFrame]:
    """(rows, cells): per row of ``docs`` mark, doc_id, cell and draw; per cell tokens, raked tokens and probability.

    Tokens are runs of other than white space.  A null text has none: its cell weighs nothing and, as
    there is nothing to balance, keeps its rows with probability ``keep``; so does any cell without tokens.
    Null sources and languages are a value of their own.
    """
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"), topic_of(text, topics).alias("topic"),
        F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens"), draw_of(seed).alias("draw"))
    rows = cut_lineage(rows, "tokens")
    total = rows.count()
    for m in ("source", "lang"):
        rows = _folded(rows, m, total)
    cells = rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))
    raked = rake(cells, MARGINS, keep, temper, targets)
    cells = raked.select(*MARGINS, "tokens", "raked", F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(F.lit(keep)).alias("probability"))
    return rows, cells


def draw_of(seed: int) -> Column:
    """Uniform draw of a row from the md5 of seed, id and text; the same for repeated rows."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def sampled(docs: DataFrame, **settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, topic (as folded), tokens, probability, kept."""
    rows, cells = mixed(docs, **settings)
    # Cells number at most (1/LEAST + 1)² times the topics, most often some hundred; adaptive execution picks the join by their size.
    met = rows.join(cells.select(*MARGINS, "probability"), list(MARGINS))
    return met.select("doc_id", *MARGINS, "tokens", F.round("probability", 6).alias("probability"), (F.col("draw") < F.round("probability", 6)).alias("kept"))


def mixture(docs: DataFrame, seed: int = 11, topics: Sequence[tuple[str, str, Sequence[str]]] = TOPICS, **settings) -> DataFrame:
    """The rows of ``docs`` that the sample keeps, with all their columns unchanged."""
    rows, cells = mixed(docs, seed=seed, topics=topics, **settings)
    values = {m: [r[0] for r in cells.select(m).distinct().collect()] for m in ("source", "lang")}
    table = cells.select(*[F.col(m).alias(f"__{m}") for m in MARGINS], F.round("probability", 6).alias("__p"))

    def folded(m: str) -> Column:
        value = F.coalesce(F.col(m).cast("string"), F.lit(NONE))
        return F.when(value.isin(values[m]), value).otherwise(F.lit(OTHER))

    keyed = docs.withColumns({"__s": folded("source"), "__l": folded("lang"), "__t": topic_of(F.col("text"), topics), "__d": draw_of(seed)})
    on = [keyed["__s"] == F.col("__source"), keyed["__l"] == F.col("__lang"), keyed["__t"] == F.col("__topic"), keyed["__d"] < F.col("__p")]
    return keyed.join(table, on, "left_semi").drop("__s", "__l", "__t", "__d")


def sql(keep: float = KEEP, temper: float = TEMPER, seed: int = 11, cycles: int = CYCLES, topics: Sequence[tuple[str, str, Sequence[str]]] = TOPICS, docs: str = "documents") -> str:
    """DuckDB SQL with the rows of ``sampled`` for default targets."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rules = " ".join(f"WHEN regexp_matches(text, {quoted(p)}) THEN {quoted(n)}" for n, p, _ in topics)
    fold = lambda m: f"CASE WHEN count(*) OVER (PARTITION BY {m}) >= {LEAST} * count(*) OVER () THEN {m} ELSE '{OTHER}' END AS {m}"
    one = f"""s0 AS (SELECT source, lang, topic, tokens::DOUBLE AS tokens, tokens::DOUBLE * {keep} AS raked,
        {", ".join(f"pow(sum(tokens) OVER (PARTITION BY {m}) / sum(tokens) OVER (), {temper}) AS share_{m}, count(*) OVER (PARTITION BY {m}) AS rows_{m}" for m in MARGINS)}
        FROM cells),
      s1 AS (SELECT source, lang, topic, tokens, raked,
        {", ".join(f"share_{m} / sum(share_{m} / rows_{m}) OVER () * {keep} * sum(tokens) OVER () AS target_{m}" for m in MARGINS)} FROM s0)"""
    scaled = lambda x, m: f"CASE WHEN sum({x}) OVER (PARTITION BY {m}) > 0 THEN {x} * target_{m} / sum({x}) OVER (PARTITION BY {m}) ELSE 0 END"
    targets = ", ".join(f"target_{m}" for m in MARGINS)
    return f"""
    WITH RECURSIVE base AS (
      SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
        CASE WHEN text IS NULL OR NOT regexp_matches(text, '\\S') THEN '{NONE}' {rules} ELSE 'prose' END AS topic,
        coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')), 0)::BIGINT AS tokens,
        ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE / {1 << 48} AS draw
      FROM {docs}),
    rows_ AS (SELECT doc_id, {fold("source")}, {fold("lang")}, topic, tokens, draw FROM base),
    cells AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM rows_ GROUP BY ALL),
    {one},
    raking AS (
      SELECT 0 AS k, source, lang, topic, tokens, raked, {targets} FROM s1
      UNION ALL
      SELECT k + 1, source, lang, topic, tokens, least({scaled("raked", "topic")}, tokens), {targets} FROM (
        SELECT k, source, lang, topic, tokens, {scaled("raked", "lang")} AS raked, {targets} FROM (
          SELECT k, source, lang, topic, tokens, {scaled("raked", "source")} AS raked, {targets} FROM raking WHERE k < {cycles}))),
    chance AS (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN raked / tokens ELSE {keep} END, 6) AS probability FROM raking WHERE k = {cycles})
    SELECT doc_id, source, lang, topic, tokens, probability, draw < probability AS kept
    FROM rows_ JOIN chance USING (source, lang, topic)"""
